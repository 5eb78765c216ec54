"""What the Jaccard join writes and shuffles follows its sets, not the keys that meet no other or the square of a family."""

import numpy as np
import pytest
from test_operators import brute_components, brute_links

from sparkassay.llm import common, jaccard

PASSAGE = [f"p{i}" for i in range(45)]


def _family(alone: int, copies: int) -> list[tuple[int, str]]:
    """Texts that share a passage: with as many words of their own, or near copies of each other in twos."""
    rows = [" ".join([*PASSAGE, *(f"a{k}x{i}" for i in range(45))]) for k in range(alone)]
    for k in range(copies):
        own = [f"c{k // 2}x{i}" for i in range(15)]
        rows.append(" ".join([*PASSAGE, *own[:-1], f"end{k}"]))
    return list(enumerate(rows))


@pytest.fixture
def seen(spark, monkeypatch):
    """Rows of all settled tables by purpose, and of families that are dealt to blocks."""
    found = {}
    plain, blocks = jaccard.settled, jaccard._in_blocks

    def settled(df, purpose, *rest):
        out = plain(df, purpose, *rest)
        found[purpose] = found.get(purpose, 0) + out.count()
        return out

    def in_blocks(placed, function, schema, carry):
        if carry == ["n"]:
            found["blocks"] = found.get("blocks", 0) + placed.count()
        return blocks(placed, function, schema, carry)

    monkeypatch.setattr(jaccard, "settled", settled)
    monkeypatch.setattr(jaccard, "_in_blocks", in_blocks)
    return found


def _checked(spark, rows, words=4, p=85, q=100):
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = jaccard.jaccard_components(table, words, (p, q)).collect()
    parent, _ = brute_components(rows, words, p, q)
    assert {r.doc_id: r.component_id for r in got} == parent
    assert sorted((r.doc_id, r.n_shingles, r.n_links) for r in got) == sorted(brute_links(rows, words, p, q))


def test_keys_that_meet_no_other_are_not_written(spark, seen):
    rows = [(k, " ".join(f"w{k}x{i}" for i in range(300))) for k in range(40)]
    rows.append((40, rows[7][1] + " more"))
    _checked(spark, rows)
    # a document has about a hundred keys; two of them share some
    assert 41 < seen["jaccard-keys"] < 41 + 400


def test_only_sets_that_can_link_are_compared_in_blocks(spark, seen, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    monkeypatch.setattr(jaccard, "listing", _all_in_one_list(jaccard.listing))
    _checked(spark, _family(120, 24))
    assert seen["jaccard-sifted"] > 0 and seen.get("blocks", 0) <= 2 * 24


def _all_in_one_list(listing):
    """Every set is in one list more, with all others."""

    def one_list(words, sizes, limit):
        work = listing(words, sizes, limit)

        def more(batches):
            import pyarrow as pa

            for out in work(batches):
                yield out
                if out["kind"][0].as_py() == jaccard.DOCUMENT:
                    first = out.filter(pa.compute.is_valid(out["sid"]))
                    columns = {name: first[name] for name in first.schema.names}
                    columns["kind"] = pa.array([jaccard.FIRST] * len(first), pa.int8())
                    columns["doc_id"] = pa.nulls(len(first), pa.int64())
                    columns["key"] = pa.array([77] * len(first), pa.int64())
                    columns["side"] = pa.array([2] * len(first), pa.int8())
                    yield pa.RecordBatch.from_pydict(columns, schema=out.schema)

        return more

    return one_list


@pytest.mark.parametrize(("block", "room", "copies"), [(8, 1 << 20, 2), (30, 150, 1)])
def test_families_in_parts_and_rounds(spark, monkeypatch, block, room, copies):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "ROOM", room)
    monkeypatch.setattr(jaccard, "COPIES", copies)
    monkeypatch.setattr(jaccard, "listing", _all_in_one_list(jaccard.listing))
    rows = _family(30, 20)
    rng = np.random.default_rng(6)
    for k in range(40):
        w = [f"s{i}" for i in range(60)]
        for at in rng.integers(0, 60, rng.integers(0, 6)):
            w[at] = f"new{k}"
        rows.append((len(rows), " ".join(w)))
    _checked(spark, rows)


def test_members_alone_are_counted_within_rooms(spark):
    rng = np.random.default_rng(7)
    sets = [np.unique(np.append(rng.integers(0, 60, 20), rng.integers(1 << 40, 1 << 62, k))) for k in range(30)] + [np.zeros(0, np.int64)]
    rows = [(1, 7 if i % 2 else 1, i, len(s), s.tolist()) for i, s in enumerate(sets)] * 2  # rows that repeat a set
    table = spark.createDataFrame(rows, "centre long, _rooms long, sid long, n int, _set array<long>").where("_rooms = 7")
    dealt = table.mapInArrow(jaccard._dealt_to_rooms, "centre long, _room long, sid long, n int, _set array<long>")
    assert dealt.select("_room").distinct().count() <= 7
    got = common.settled(dealt.groupBy("centre", "_room").applyInArrow(jaccard._alone, "centre long, sid long, n int, _alone long"), "test")
    got = {r["sid"]: r["_alone"] for r in got.groupBy("sid").agg({"_alone": "sum"}).withColumnRenamed("sum(_alone)", "_alone").collect()}
    there = {i: s for i, s in enumerate(sets) if i % 2 and len(s)}
    for i, s in there.items():
        others = np.concatenate([t for j, t in there.items() if j != i])
        assert got[i] == len(np.setdiff1d(s, others))
