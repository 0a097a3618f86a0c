"""Pairs whose shared prefix shingles have their centres on both sides."""

import pytest

from reportforge.llm import jaccard


def bridge_family(of_p, of_q, of_1, of_2):
    """Texts of p, q within p, c1 near p alone and c2 near q alone; of_1, of_2: (words of q, other words) of c1 and c2.

    One rare word stands in p, q and c1, another in p, q and c2; these two are all that the prefixes of p and q share.
    """
    q = [f"q{i}" for i in range(of_q)]
    e = [f"e{i}" for i in range(of_p - of_q - 1)]
    o = [f"o{i}" for i in range(of_2[1])]
    p = ["alone", *e, *q]
    c1 = [*e[: of_1[1]], q[0], *q[2 : 1 + of_1[0]]]
    c2 = [*o, q[1], *q[len(q) + 1 - of_2[0] :]]
    own = lambda name, n: [f"{name}{i}" for i in range(n)]
    fill = [[*q[2:], *own("f", 3 * of_p)], [*e[of_1[1] :], *own("g", 2 * of_p)], [*o, *own("z", of_p)]]
    return [(i, " ".join(words)) for i, words in enumerate([p, q, c1, c2, *fill], 1)]


@pytest.mark.parametrize("percent, sizes", [(80, (500, 400, (340, 70), (370, 40))), (90, (500, 450, (425, 30), (435, 20)))])
def test_links_over_centres_of_both_sides(spark, percent, sizes):
    rows = bridge_family(*sizes)
    sets = {d: set(t.split()) for d, t in rows}
    near = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}
    assert near == {(1, 2), (1, 3), (2, 4)}
    got = jaccard.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), 1, percent).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 6, 7: 7}
