import random

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import graph, minhash

from .helpers import AWKWARD, documents, prose


def brute(rows, width, percent):
    """Exact sets, all pairs, components by repeated minima."""
    sets = {}
    for i, t in rows:
        words = (t or "").encode().lower().split()
        sets[i] = {tuple(words)} if 0 < len(words) < width else {tuple(words[k : k + width]) for k in range(len(words) - width + 1)} if words else set()
    label = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return {i: (len(sets[i]), label[i]) for i in sets}


def near_copies(base: str, n: int, edits: int, seed: int):
    rng, words = random.Random(seed), base.split()
    for _ in range(n):
        w = list(words)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
        yield " ".join(w)


def test_groups_of_copies_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(minhash, "TILE", 16)  # the group of near copies is cut into blocks
    texts = [prose(i) for i in range(30)] + list(near_copies(prose(99, 160), 60, 7, 1)) + [prose(5)] * 20 + ["a b", "A B", "a", None, ""]
    rows = list(enumerate(texts, 10))
    random.Random(2).shuffle(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(documents(spark, rows), 4, 80).collect()}
    assert got == brute(rows, 4, 80)


def test_crowded_bucket_of_strangers(spark, monkeypatch):
    sign = minhash._sign

    def one_bucket(width):
        def run(batches):
            for batch in sign(width)(batches):
                keys = [None if k is None else [7] for k in batch["keys"].to_pylist()]
                yield batch.set_column(4, "keys", pa.array(keys, pa.list_(pa.int64())))

        return run

    monkeypatch.setattr(minhash, "_sign", one_bucket)  # every document meets every other in one bucket only
    monkeypatch.setattr(minhash, "CROWD", 8, raising=False)  # which is cut into blocks
    rows = list(enumerate([prose(i) for i in range(30)] + [t for i in range(30) for t in near_copies(prose(i), 1, 3, i)], 10))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(documents(spark, rows), 4, 80).collect()}
    want = brute(rows, 4, 80)
    assert got == want and len({c for _, c in want.values()}) == 30


def drifting(seed, n, step, words=120):
    """Texts each of which differs from the one before in a few words: neighbours are near, others are not."""
    rng = random.Random(seed)
    text = prose(seed, words).split()
    for _ in range(n):
        yield " ".join(text)
        for i in rng.sample(range(words), step):
            text[i] = "".join(rng.choice("klmnopqrst") for _ in range(6))


def filled(seed, n, words=120, blanks=18):
    """Texts of one template, with words of their own in its blanks: alike, but not near."""
    rng = random.Random(seed)
    form, at = prose(seed, words).split(), sorted(rng.sample(range(words), blanks))
    for _ in range(n):
        text = list(form)
        for i in at:
            text[i] = "".join(rng.choice("uvwxyz") for _ in range(7))
        yield " ".join(text)


def test_chains_and_templates_in_large_clusters(spark, monkeypatch):
    monkeypatch.setattr(minhash, "TILE", 8)
    monkeypatch.setattr(minhash, "MOST_TILE", 8)
    monkeypatch.setattr(minhash, "COARSE", 0.2)  # templates hang together by signatures
    monkeypatch.setattr(minhash, "CLOSE", 0.55)
    texts = [*drifting(1, 40, 3), *filled(2, 50), *drifting(3, 25, 2), *near_copies(prose(4, 160), 60, 7, 1)]
    rows = list(enumerate(texts, 100))
    random.Random(3).shuffle(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(documents(spark, rows), 4, 80).collect()}
    want = brute(rows, 4, 80)
    assert got == want and len({want[i][1] for i in range(100, 140)}) < 5 and len({want[i][1] for i in range(140, 190)}) == 50


def test_recall_past_leaders():
    """Of pairs at 0.8 that share a bucket with a leader between them, hardly any is parted."""
    rng, a = np.random.default_rng(4), minhash.multipliers()
    parted = 0
    for _ in range(200):
        x = rng.integers(0, 2**63, 450, dtype=np.uint64)
        one, other = x[:400], x[50:]  # 350 of 450 shared: 0.78
        lead = np.concatenate([x[:220], rng.integers(0, 2**63, 180, dtype=np.uint64)])
        s = [((minhash.signature(v, a) * minhash._M1) >> minhash.U64(56)).astype(np.uint8) for v in (one, other, lead)]
        agree = lambda i, j: (s[i] == s[j]).mean()
        together = min(agree(0, 2), agree(1, 2)) >= minhash.COARSE
        compared = max(agree(0, 2), agree(1, 2)) < minhash.CLOSE and agree(0, 1) >= minhash.COARSE
        parted += not (together or compared)
    assert parted == 0


def test_awkward_rows(spark):
    out = minhash.near_duplicates(documents(spark, AWKWARD)).collect()
    assert len(out) == len(AWKWARD)
    by = {r.doc_id: r for r in out}
    assert [by[i].n_shingles for i in (1, 2, 3, 4)] == [0, 0, 0, 1] and by[7].component_id == 4 and not by[7].kept and by[4].kept
    assert by[None].component_id is None and by[None].kept and by[1].kept and by[2].component_id == 2
    kept = minhash.kept_rows(documents(spark, AWKWARD))
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 6] and kept.columns == documents(spark, AWKWARD).columns


def test_empty_table(spark):
    assert minhash.near_duplicates(documents(spark, [(1, "a")]).limit(0)).collect() == []


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    a = minhash.multipliers()
    x = rng.integers(0, 2**63, 400, dtype=np.uint64)
    x, y = x[:300], x[100:]
    agree = (minhash.signature(x, a) == minhash.signature(y, a)).mean()
    assert abs(agree - 0.5) < 0.12
    assert (minhash.signature(x, a, 7) == minhash.signature(x, a)).all()


@pytest.mark.parametrize("task_links", [1_000_000, 3])
def test_components_in_one_task_and_by_stars(spark, task_links):
    links = [(i, i + 1) for i in range(1, 9)] + [(20, 30), (30, 25), (25, 21), (5, 1), (7, 7), (None, 3), (40, 41)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long"), "a", "b", task_links).collect()}
    assert got == {**{i: 1 for i in range(1, 10)}, 20: 20, 21: 20, 25: 20, 30: 20, 40: 40, 41: 40}
