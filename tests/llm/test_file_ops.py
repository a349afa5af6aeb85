"""op5, op6, op10 and the pipeline: round trips, damage, and restated decisions."""

import hashlib
import io
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import brute
from urlatlas.llm import packing, token_records, warc
from urlatlas.llm.common import work_dir

WORD_BPE, BYTE_BPE = (public_tokenizers.path(f) for f in ("word_bpe_49k.json", "byte_bpe_50k.json"))
TEXTS = [(4, "Some words here."), (2, None), (9, ""), (7, "naïve café … 漢字"), (7, "naïve café … 漢字"), (None, "no id"),
         (3, "long text " * 9000), (5, "<|endoftext|> x"), (1, "a")]


def plain_ids(path, text, end):
    return [*Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_records_round_trip(frame, spark):
    files = token_records.write_records(frame(TEXTS), work_dir(spark), BYTE_BPE)
    got = [tuple(r) for r in token_records.read_records(spark, files).collect()]
    order = sorted(TEXTS, key=lambda t: (t[0] is not None, t[0] or 0))
    want, start = [], 0
    for i, t in order:
        ids = plain_ids(BYTE_BPE, t, 0)
        want.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    assert got == want
    shuffled = [(f, k) for f in files for k in range(f.records)]
    random.Random(1).shuffle(shuffled)
    seen = {(token_records.read_at(f.path, f.index_path, k)[0], crc(np.frombuffer(token_records.read_at(f.path, f.index_path, k)[1], "<u4")))
            for f, k in shuffled}
    assert seen == {(i, c) for i, _, _, c in want}
    assert token_records.read_records(spark, token_records.write_records(frame([]), work_dir(spark), BYTE_BPE)).collect() == []


@pytest.mark.parametrize("short", [True, False])
def test_damaged_records_are_noticed(short):
    ids = np.arange(20, dtype="<u4").tobytes()
    good = token_records.frame(5, ids, short)
    assert token_records.read_record(io.BytesIO(good)) == (5, ids, len(good))
    assert token_records.read_record(io.BytesIO(token_records.frame(None, b"", short)))[:2] == (None, b"")
    for k in range(len(good)):
        with pytest.raises(ValueError):
            token_records.read_record(io.BytesIO(good[:k] + bytes([good[k] ^ 1]) + good[k + 1:]))
    for k in range(1, len(good)):
        with pytest.raises(ValueError):
            token_records.read_record(io.BytesIO(good[:k]))


def unpack_plan(plan, cap):
    bins = defaultdict(list)
    for length, _, count, first, per, offset in plan.tolist():
        for k in range(count):
            bins[first + k // per].append((offset + k % per * length, length))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= cap.tokens and len(pieces) <= cap.documents and sum(n * n for _, n in pieces) <= cap.attention
    return bins


@pytest.mark.parametrize("score", ["residual_norm", "dot_product"])
def test_plans_hold_every_capacity(score):
    rnd = random.Random(6)
    for cap in (packing.Capacity(score=score), packing.Capacity(100, 5, 4000, score=score), packing.Capacity(50, 50, 900, score=score)):
        for _ in range(30):
            top = int(min(cap.tokens, cap.attention ** 0.5))
            histogram = {rnd.randint(1, top): rnd.randint(1, 400) for _ in range(rnd.randint(1, 40))}
            bins = unpack_plan(packing.plan_bins(histogram, cap), cap)
            met = defaultdict(int)
            for pieces in bins.values():
                for _, n in pieces:
                    met[n] += 1
            assert met == histogram and sorted(bins) == list(range(len(bins)))
    with pytest.raises(ValueError):
        packing.plan_bins({101: 1}, packing.Capacity(100))


def test_plan_is_close_to_the_least_number_of_bins():
    rnd = random.Random(7)
    histogram = defaultdict(int)
    for _ in range(20000):
        histogram[min(4096, int(rnd.lognormvariate(6.5, 1)) + 1)] += 1
    bins = unpack_plan(packing.plan_bins(histogram, packing.Capacity()), packing.Capacity())
    least = -(-sum(n * c for n, c in histogram.items()) // 4096)
    assert len(bins) <= 1.005 * least + 1


def test_pack_whole_documents(frame):
    got = packing.pack(frame(TEXTS), WORD_BPE).collect()
    want = []
    for i, t in TEXTS:
        ids = plain_ids(WORD_BPE, t, 1)
        want += [(i, p, a, len(ids[a:a + 4096]), crc(ids[a:a + 4096])) for p, a in enumerate(range(0, len(ids), 4096))]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) == -(-sum(r.length for r in got) // 4096)
    assert packing.pack(frame([]), WORD_BPE).collect() == []


def test_warc_round_trip(spark):
    long = "<p>" + "Größe " * 40000
    rows = [(5, "http://a/", long), (3, "http://b/ x\r\ny", long), (9, None, long), (1, "u", "short"), (2, "u", "short"),
            (4, "u", None), (None, "u", long), (3, "http://b/", long), (6, "u", "é" * 50), (7, "u", "é" * 50), (8, "u", "WARC/1.1\r\n\r\n")]
    # URLs come back as they were: white space of all kinds, escapes, quotes, none at all, and 2 MB of one
    odd = ["", " ", "http://a/b c\td\u00a0", "\u2028x\x85", "http://a/%20%09?q=100%", "a: b", '"', "http://\u6f22/\x7f", "\x00\r\n\r\n",
           "http://a/" + "\u00e9x" * 700_000]
    rows += [(100 + k, u, "") for k, u in enumerate(odd)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumnsRenamed({}).selectExpr(
        "*", "'x' AS digest", "1 AS first", "2 AS revisit")
    files = warc.write_archives(pages, work_dir(spark), file_bytes=500)
    got = warc.read_archives(spark, files).collect()
    assert len(files) > 1 and len(got) == len(rows)
    first = {long: 3, "é" * 50: 6}
    want = []
    for i, u, h in rows:
        data = (h or "").encode()
        revisit = len(data) >= 100 and h in first and i != first[h]
        want.append((i, u, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first[h] if revisit else None))
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "", r[2])
    assert sorted(((r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=key) == sorted(want, key=key)
    assert warc.read_archives(spark, warc.write_archives(pages.limit(0), work_dir(spark))).collect() == []


def test_warc_reader_checks_what_it_reads():
    body = ("<p>" + "text " * 50000).encode()
    digest = hashlib.sha256(body).hexdigest()
    one = warc.write_record(1, "u", body, digest, None, False, "2000-01-01T00:00:00Z")
    two = warc.write_record(2, "u", body, digest, 1, True, "2000-01-01T00:00:00Z")
    got = list(warc.read_records(io.BytesIO(one + two + one), keep_payload=True))
    assert [(r.page_id, r.kind, r.size, r.refers_to) for r in got] == [
        (1, "response", len(body), None), (2, "revisit", len(body), 1), (1, "response", len(body), None)]
    assert got[0].payload == body and got[1].payload is None and zlib.decompress(one, 31).startswith(b"WARC/1.1\r\n")
    raw = zlib.decompress(one, 31)
    pack = lambda data: zlib.compress(data, wbits=31)
    for bad in (raw.replace(b"text ", b"tent ", 1), raw[:-1], raw + b"x", raw.replace(b"Content-Length: ", b"Content-Length: 1", 1)):
        with pytest.raises(ValueError):
            list(warc.read_records(io.BytesIO(pack(bad))))
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(one[:-3])))


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline
    from test_search_ops import toxic_docs
    docs, labels = toxic_docs(120)
    rnd = random.Random(11)
    fresh = lambda n: " ".join("".join(rnd.choice("bcdfghjk") for _ in range(5)) for _ in range(n))
    passage, item = fresh(60), fresh(30)
    docs += [(200, fresh(80) + "\n" + passage), (201, passage + "\n" + fresh(90)), (202, docs[1][1]), (203, docs[1][1].upper()),
             (204, fresh(100) + " " + item + " " + fresh(50)), (205, None), (206, ""), (207, fresh(5))]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    out = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, now, str(tmp_path))
        assert after.columns == now.columns
        path = str(tmp_path / name)
        after.write.parquet(path)
        now = spark.read.parquet(path)
        out[name] = {r.doc_id: r for r in now.collect()}
    marked = {i for i, y in labels if y}
    assert set(out["toxicity"]) == {i for i, _ in docs} - marked
    texts = {i: t or "" for i, t in docs if i not in marked}
    assert {i: r.text or "" for i, r in out["line_dedup"].items()} == brute.drop_repeated_lines(sorted(texts.items()))
    assert all(r.n_chars == len(r.text or "") for r in out["line_dedup"].values())
    fps = {i: brute.simhash(r.text) for i, r in out["line_dedup"].items()}
    assert set(out["simhash"]) == set(brute.components(fps).values())
    assert set(out["simhash"]) - set(out["decontamination"]) == {204}
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(out["decontamination"])
