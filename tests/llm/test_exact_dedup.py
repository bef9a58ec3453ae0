import hashlib
from collections import Counter, defaultdict

import pytest

from gleaner.llm import exact_dedup

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = str.maketrans(UPPER, UPPER.lower())


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[(r[1] or "").translate(LOWER)].append(r[0])
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(text.encode()).hexdigest()
        out += [(i, keep, len(ids), sha) for i in ids]
    return Counter(out), groups


@pytest.mark.parametrize("params", [
    exact_dedup.ExactDedupParams(),
    exact_dedup.ExactDedupParams(files_per_batch=1, digest_bytes=1),
])
def test_groups_equal_brute_force_even_when_digests_collide(docs, rows, params):
    got = exact_dedup.dedup(docs, params=params).collect()
    expected, groups = brute(rows)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == expected
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups)
    assert all(r.doc_id == r.keep_id for r in kept)


def test_state_carries_over_batches(spark, docs, tmp_path):
    """A second run over the same folders goes on from the keyed state."""
    rows = exact_dedup.fingerprints(docs.select("doc_id", "text"), "doc_id", "text", exact_dedup.ExactDedupParams())
    first, source = rows.limit(20), str(tmp_path / "in")
    for part in (first, rows.exceptAll(first)):
        part.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(rows.schema).parquet(source)
        exact_dedup.stream_groups(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    totals = spark.read.parquet(str(tmp_path / "out")).groupBy("digest").agg({"n": "max"}).collect()
    assert sum(r[1] for r in totals) == rows.count()
    assert len(totals) == rows.select("digest").distinct().count()


def test_survivors_keep_one_row_and_all_columns(docs, rows):
    left = exact_dedup.survivors(docs)
    assert left.columns == docs.columns
    _, groups = brute(rows)
    texts = Counter((r.text or "").translate(LOWER) for r in left.collect())
    assert texts == Counter(dict.fromkeys(groups, 1))


def test_empty_table(no_docs):
    assert exact_dedup.dedup(no_docs).count() == 0
    assert exact_dedup.survivors(no_docs).count() == 0
