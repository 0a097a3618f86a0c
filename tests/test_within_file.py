"""Rows that share a passage with an earlier kept row."""

import os
import re

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_within_file_dup_reads_whole_texts(spark):
    holder, want = {}, {}
    for d, t in sorted(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()):
        w = re.findall("[a-z0-9]+", (t or "").lower())
        grams = {tuple(w[i : i + 8]) for i in range(max(1, len(w) - 7))} if w else set()
        want[d] = min((holder[g] for g in grams if g in holder), default=None)
        if want[d] is None:
            holder |= dict.fromkeys(grams, d)
    assert any(k is not None for k in want.values())
    got = entry.queries()["within_file_dup"](spark, SF).collect()
    assert {r["id"]: r["keeper"] for r in got} == want and all(r["kept"] == (r["keeper"] is None) for r in got) and len(got) == len(want)


def test_shared_passages_are_few_rows(spark, monkeypatch):
    """What is written grows with the passages that rows share, not with their words. A null id holds nothing back."""
    from reportforge.operators import similarity as M

    long, rows, told = [f"w{i}" for i in range(3000)], [], []
    for k in range(20):
        rows.append((k, " ".join(long[100 * k :])))
    rows += [(30, " ".join(f"v{i}" for i in range(50))), (31, "v1 v2 v3"), (32, "V1, v2 v3"), (33, None), (None, "v1 v2 v3")]
    for name, f in (("checkpointed", M.checkpointed), ("Work.write", M.Work.write if hasattr(M, "Work") else None)):
        if f is not None:
            monkeypatch.setattr(f"reportforge.operators.similarity.{name}", lambda *a, f=f: told.append(a[-1].count()) or f(*a))
    got = {r.id: (r.kept, r.keeper) for r in M.within_file_duplicates(spark.createDataFrame(rows, "id long, t string").repartition(3), "id", "t").collect()}
    assert got == {0: (True, None)} | {k: (False, 0) for k in range(1, 20)} | {30: (True, None), 31: (True, None), 32: (False, 31), 33: (True, None), None: (True, None)}
    assert sum(told) < 3000
