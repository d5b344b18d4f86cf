import pytest

from millrace.operators.policy import ME, Grant, Principal, allowed_ids, broad, change_allowed, held, may_grant, minted, run_as, visible
from millrace.operators.query import Test as Check
from millrace.operators.query import form
from worlds import forge, ids

ONE, THREE, NOBODY = Principal(1), Principal(3), Principal()
PUBLIC = Grant("anon", "see", "Repo", tests=(Check("visibility", "=", "public"),))


@pytest.fixture(scope="module")
def w(spark):
    return forge(spark)


def seen(w, entity, grants, who):
    return sorted(ids(visible(w, entity, w.rows(entity), grants, who)))


@pytest.mark.parametrize(
    ("entity", "grants", "who", "want"),
    [
        ("Issue", [], ONE, []),
        ("Issue", [], Principal(sudo=True), [1, 2, 3, 4]),
        ("Issue", [Grant("anon", "see", "*")], NOBODY, [1, 2, 3, 4]),
        ("Issue", [Grant("all", "see", "Issue")], NOBODY, []),
        ("Issue", [Grant("1", "see", "Issue")], ONE, [1, 2, 3, 4]),
        ("Issue", [Grant("1", "set", "Issue")], ONE, []),
        ("Issue", [Grant("1", "*", "Actor", row=1)], ONE, [1, 2, 4]),
        ("Issue", [Grant("Team 1", "see", "Repo", row=3)], THREE, [3]),
        ("Issue", [Grant("Team 1", "see", "Repo", row=3)], ONE, []),
        ("Issue", [Grant("Team 2", "see", "Issue")], Principal(2), []),
        ("Repo", [PUBLIC], NOBODY, [1]),
        ("Issue", [PUBLIC], NOBODY, [1, 4]),
        ("Issue", [Grant("all", "see", "Issue", tests=(Check("author_id", "=", ME),))], THREE, [1, 3]),
        ("Issue", [Grant("anon", "see", "Issue", tests=(Check("author_id", "=", ME),))], NOBODY, []),
        ("Issue", [Grant("1", "see", "Issue", row=99)], ONE, []),
    ],
)
def test_visibility(w, entity, grants, who, want):
    assert seen(w, entity, grants, who) == want


def test_owner_predicates_cover_seeing_only(w):
    grants = [Grant("1", "*", "Repo", tests=(Check("visibility", "=", "private"),))]
    rows = w.rows("Issue")
    assert sorted(ids(visible(w, "Issue", rows, grants, ONE))) == [2, 3]
    assert ids(visible(w, "Issue", rows, grants, ONE, "set")) == []


def test_page_is_cut_before_the_filter(w):
    grants = [Grant("3", "see", "Issue", tests=(Check("author_id", "=", ME),))]
    assert ids(run_as(w, form("Issue").order("id").top(2), grants, THREE).rows) == [1]
    assert run_as(w, form("Issue").order("id").top(2).count(), grants, THREE).count.first()[0] == 1
    assert run_as(w, form("Issue").count(), grants, THREE).count.first()[0] == 2


def test_links_need_both_ends(w):
    grants = [Grant("1", "see", "Team")]
    assert ids(run_as(w, form("Team").link("members"), grants, ONE).links["Team.members"]) == []
    grants.append(Grant("1", "see", "Actor", row=3))
    assert ids(run_as(w, form("Team").link("members"), grants, ONE).links["Team.members"]) == [1]


def test_changes_are_held_against_both_images(w):
    grants = [Grant("3", "*", "Issue", tests=(Check("author_id", "=", ME),))]
    after = w.rows("Issue").filter("id in (1, 2, 3)").selectExpr("id", "title", "no", "repo_id", "CASE WHEN id = 3 THEN 1L ELSE author_id END AS author_id")
    assert ids(change_allowed(w, "Issue", after, grants, THREE)) == [1]
    assert sorted(ids(change_allowed(w, "Issue", after, [Grant("3", "*", "Issue")], THREE))) == [1, 2, 3]


def test_minting_and_handing_on(w):
    fresh = w.rows("Repo").filter("id = 2")
    assert [tuple(r) for r in minted(w, "Repo", fresh, [], ONE).collect()] == [("1", "*", "Repo", "row 2")]
    assert minted(w, "Repo", fresh, [Grant("1", "*", "Actor", row=1)], ONE).count() == 0
    mine = [Grant("1", "see", "Actor", row=1)]
    assert may_grant(w, Grant("3", "see", "Repo", row=2), mine, ONE)
    assert not may_grant(w, Grant("3", "set", "Repo", row=2), mine, ONE)
    assert not may_grant(w, Grant("3", "see", "Repo", row=3), mine, ONE)
    assert not may_grant(w, Grant("3", "see", "*"), [Grant("1", "see", "*")], ONE)
    assert broad(w, "Repo", [Grant("1", "see", "*")], ONE) and not broad(w, "Repo", mine, ONE)
    assert held(w, mine, NOBODY, "see") == [] and allowed_ids(w, "Repo", [Grant("1", "see", "Repo")], ONE, "see") is None
