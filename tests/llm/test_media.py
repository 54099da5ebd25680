import hashlib
import tarfile
import zlib

import pytest

from tesserae.llm import media
from tesserae.llm.catalog import LLM_QUERIES
from tesserae.llm.common import documents, shared_dir


def test_round_trip():
    for text in (None, "", "a", "x" * 64, "ü" * 1000, "\0" * 65):
        payload, n = media.payload_of(text)
        assert n == len((text or "").encode()) and len(payload) % 64 == 0 and len(payload) >= 64
        stored = media.encode_image(payload)
        assert media.decode_image(stored) == payload
        assert media.image_header(stored[: media.HEADER]) == (64, len(payload) // 64, 8)
    with pytest.raises(ValueError):
        media.image_header(b"no image at all" * 3)


def test_rows_carry_places_in_real_tar_files(spark, docs):
    folder = shared_dir(spark, "media-test")
    manifest = media.write_shards(docs, folder)
    rows = manifest.collect()
    texts = docs.collect()
    assert len(rows) == len(texts)
    found = {}
    for name in {r["shard"] for r in rows}:
        with tarfile.open(f"{folder.removeprefix('file://')}/{name}") as tar:
            for m in tar.getmembers():
                assert (name, m.offset_data) not in found
                found[name, m.offset_data] = tar.extractfile(m).read()
    for r in rows:
        stored = found[r["shard"], r["offset"]]
        assert len(stored) == r["length"]
        assert hashlib.sha256(media.decode_image(stored)).hexdigest() == r["digest"]
    by_shard = [(r["shard"], r["digest"]) for r in rows]
    assert len(set(by_shard)) == len(found)  # a payload once a shard
    heads = media.read_metadata(manifest, folder).collect()
    assert all(h["width"] == 64 and h["bits"] == 8 for h in heads)


def test_rotation(tmp_path):
    w = media.ShardWriter(f"file://{tmp_path}", 0, most=2000)
    places = [w.put(f"{i:064x}", lambda i=i: bytes([i]) * 700) for i in range(5)]
    w.close()
    assert len({p[0] for p in places}) > 1
    reader = media.Shards(f"file://{tmp_path}")
    assert [reader.read(*p) for p in places] == [bytes([i]) * 700 for i in range(5)]


def test_query(spark, sf, none):
    rows = {r["doc_id"]: r for r in LLM_QUERIES["op9_media_columns"](spark, sf).collect()}
    for r in documents(spark, sf).collect():
        payload, n = media.payload_of(r["text"])
        stored, got = media.encode_image(payload), rows[r["doc_id"]]
        assert (got["n_bytes"], got["payload_bytes"]) == (n, len(payload))
        assert got["payload_sha256"] == hashlib.sha256(payload).hexdigest() and got["tail_crc32"] == zlib.crc32(payload[-64:])
        assert (got["media_bytes"], got["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
    folder = shared_dir(spark, "media-test")
    assert media.read_features(media.write_shards(none, folder), folder).collect() == []
