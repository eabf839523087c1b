import zlib
from collections import Counter

import pytest

from satzwerk.llm import sharding


def test_laws_of_the_query(docs, rows, empty):
    found = sharding.shard_documents(docs, 8).collect()
    assert len(found) == len(rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in found) == Counter(
        (d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in rows
    )
    for shard in {r.shard for r in found}:
        assert sorted(r.slot for r in found if r.shard == shard) == list(range(sum(r.shard == shard for r in found)))
    assert all(r.law == "key" and r.grown_shard in (r.shard, 8) for r in found)
    assert sharding.shard_documents(empty, 8).collect() == []


def test_the_shard_of_an_id_is_the_same_in_any_table(docs):
    one = {r.doc_id: (r.shard, r.grown_shard) for r in sharding.shard_documents(docs.where("doc_id > 120"), 8).collect()}
    two = {r.doc_id: (r.shard, r.grown_shard) for r in sharding.shard_documents(docs, 8).collect()}
    assert all(two[d] == place for d, place in one.items())


@pytest.mark.parametrize("shards", [1, 2, 7, 8, 40])
def test_growing_moves_slots_to_the_new_shard_alone(shards):
    before = sharding.first_map(shards)
    after = sharding.grown(before)
    assert after == sharding.first_map(shards + 1)
    assert {b for a, b in zip(before, after, strict=True) if a != b} == {shards}
    counts = Counter(after)
    assert max(counts.values()) - min(counts.values()) <= shards + 1 and len(counts) == shards + 1


def test_bytes_are_evened_out_by_moving_few_slots():
    owners = sharding.first_map(4, 64)
    sizes = {slot: 1000 if owners[slot] == 2 else 100 for slot in range(64)}
    new = sharding.rebalanced(owners, sizes, 0.05)
    load = Counter()
    for slot, shard in enumerate(new):
        load[shard] += sizes[slot]
    assert max(load.values()) <= 1.05 * sum(load.values()) / 4
    assert sum(a != b for a, b in zip(owners, new, strict=True)) < 30
    assert sharding.rebalanced(new, sizes, 0.05) == new


def test_versions_of_a_map_are_kept(spark, tmp_path):
    versions = [sharding.first_map(3, 32), sharding.first_map(4, 32)]
    sharding.write_map(spark, str(tmp_path / "map"), versions)
    assert sharding.read_map(spark, str(tmp_path / "map")) == versions


def test_slot_bytes(docs, rows):
    assert sum(sharding.slot_bytes(sharding.records_of(docs)).values()) == sum(len((t or "").encode()) + 1 for _, t, *_ in rows)
