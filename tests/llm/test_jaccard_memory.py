"""What a task of the Jaccard join holds at once follows its bounds, not the length or number of its texts."""

import tracemalloc

import numpy as np
import pyarrow as pa

from sparkassay.llm import common, jaccard


def _peak(work) -> float:
    """MB that `work` has at most."""
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


class _Captured:
    """Stands for a table; keeps the function that its tasks would run."""

    def select(self, *columns):
        return self

    def mapInArrow(self, function, schema):
        return function


def test_keys_of_one_batch_go_in_several_gatherings(spark):
    texts = [" ".join(f"w{i}x{j}" for j in range(24)) for i in range(400)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(400)), "text": texts})
    work = jaccard.listed(_Captured(), 5, jaccard.Sizes(80, 100), 20)
    rows = [0, 0, 0]

    def run():
        for out in work(iter([batch])):
            for kind in (jaccard.DOCUMENT, jaccard.FIRST, jaccard.NEXT):
                rows[kind] += out["kind"].to_pylist().count(kind)

    assert _peak(run) < 100
    assert rows[jaccard.DOCUMENT] == 400 and rows[jaccard.FIRST] + rows[jaccard.NEXT] > 4 * jaccard.TOGETHER


def test_members_of_few_sets_are_not_multiplied():
    rng = np.random.default_rng(3)
    top = np.arange(50)  # what all sets share
    sets = [np.unique(np.concatenate([top, rng.integers(100, 1 << 40, 500)])) for _ in range(1024)]
    sets[7] = np.unique(np.concatenate([sets[8][:400], sets[9][:100]]))
    seen = []
    assert _peak(lambda: seen.append(jaccard._shared(sets, sets))) < 90
    for i, j in [(7, 8), (8, 7), (7, 9), (0, 1), (5, 5), (7, 7), (1023, 3)]:
        assert seen[0][i, j] == len(np.intersect1d(sets[i], sets[j]))
    assert (seen[0] >= 50).all() and (seen[0] == seen[0].T).all()


def test_intersections_by_brute_force(monkeypatch):
    monkeypatch.setattr(jaccard, "PAIRS", 7)
    monkeypatch.setattr(jaccard, "COLUMNS", 3)
    rng = np.random.default_rng(4)
    for share in (0, 1 / 16, 1 / 4, 1):
        monkeypatch.setattr(jaccard, "COMMON", share)
        for width in (3, 30, 300):
            a, b = ([np.unique(rng.integers(-width, width, rng.integers(0, 12))) for _ in range(n)] for n in (9, 5))
            want = [[len(np.intersect1d(x, y)) for y in b] for x in a]
            np.testing.assert_array_equal(jaccard._shared(a, b), want)


def test_texts_reach_tasks_in_batches_of_bounded_bytes(spark):
    texts = spark.range(0, 600, 1, 1).selectExpr("id", "repeat('a', 10000) AS text")
    before = spark.conf.get(common.BATCH_BYTES)

    def bytes_of(batches):
        for rows in batches:
            yield pa.RecordBatch.from_pydict({"n": [sum(len(t) for t in rows["text"].to_pylist())]})

    n = [r["n"] for r in common.settled(texts.mapInArrow(bytes_of, "n long"), "test", 1 << 18).collect()]
    assert sum(n) == 6_000_000 and max(n) <= 2 << 18
    assert spark.conf.get(common.BATCH_BYTES) == before


def test_steps_on_texts_ask_for_bounded_batches(spark, monkeypatch):
    asked = []
    plain = jaccard.settled
    monkeypatch.setattr(jaccard, "settled", lambda df, purpose, *batch: asked.append((purpose, *batch)) or plain(df, purpose, *batch))
    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join([*words, "more"])), (3, "else")], "doc_id long, text string")
    got = {r["doc_id"]: (r["component_id"], r["n_links"]) for r in jaccard.jaccard_components(docs).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (3, 0)}
    assert {a for a in asked if a[0] in ("jaccard-keys", "jaccard-sets")} == {("jaccard-keys", 1 << 20), ("jaccard-sets", 1 << 20)}
