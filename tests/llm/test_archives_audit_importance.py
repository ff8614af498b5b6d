"""WARC archives, the filter audit and importance resampling: round trips, brute force, and the cases that docstrings define."""

import gzip
import hashlib
import io
import json
import math
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import filter_audit, importance, warc


def sentences(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))


ODD = [None, "", "one", "one", " \n\t ", "ünïcödé ☃ text", "a " * 3000, "x" * 50000, "Ab1\x00Ab1\x7fé É", sentences(1, 5000)]


class TestWarc:
    PAGES = [(4, "http://a b/\r\n\x01", "x" * 150), (3, None, "x" * 150), (9, "u", "x" * 99), (8, "u", "x" * 99), (5, "v", None), (6, "v", "é" * 50), (7, "w", "é" * 50),
             (1, "z", "a\r\n\r\nWARC/1.1\r\n\r\n" * 20), (2, "z", "☃" * 400_000), (None, "n", "x" * 150), (3, "again", "x" * 150)]

    def frame(self, spark, rows=None):
        return spark.createDataFrame([(*r, "extra") for r in (self.PAGES if rows is None else rows)], "page_id long, url string, html string, archive string")

    def test_all_pages_come_back(self, spark):
        rows = warc.archived(self.frame(spark)).collect()
        assert len(rows) == len(self.PAGES)
        got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows)
        first = {}
        for page, _, html in self.PAGES:
            if page is not None:
                first[html or ""] = min(page, first.get(html or "", page))
        want = []
        for page, _, html in self.PAGES:
            raw = (html or "").encode()
            again = page is not None and len(raw) >= 100 and first[html or ""] != page
            want.append((page, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first[html or ""] if again else None))
        assert got == Counter(want)
        text = {r.page_id: r.payload for r in rows if r.record_type == "response"}
        assert all(text[p] == (h or "") for p, _, h in self.PAGES if p in text and p != 3)

    def test_every_record_is_a_member_that_the_sidecar_finds(self, spark, tmp_path):
        warc.write_archives(self.frame(spark), f"file://{tmp_path}/whole")
        for f in (tmp_path / "whole").glob("part-*"):
            raw = f.read_bytes()
            engine = zlib.decompressobj(31)
            engine.decompress(raw)
            assert engine.eof and not engine.unused_data  # one stream
        index = warc.normalise(spark, f"file://{tmp_path}/whole", f"file://{tmp_path}/members")
        rows = [r.asDict() for r in index.collect()]
        assert len(rows) == len(self.PAGES)
        sidecars = []
        for f in (tmp_path / "members").glob("*.warc.gz"):
            raw, whole = f.read_bytes(), b""
            lines = [json.loads(x) for x in (tmp_path / "members" / f"{f.name}.idx").read_text().splitlines()]
            assert [x["offset"] for x in lines] == sorted(x["offset"] for x in lines) and sum(x["length"] for x in lines) == len(raw)
            for x in lines:
                engine = zlib.decompressobj(31)
                record = engine.decompress(raw[x["offset"] : x["offset"] + x["length"]])
                assert engine.eof and not engine.unused_data and record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
                whole += record
                sidecars.append({"archive": str(f)} | x)
            assert gzip.decompress(raw) == whole
        assert sorted(map(str, sidecars)) == sorted(map(str, rows))
        assert not list((tmp_path / "members").glob("*.part*"))
        again = warc.normalise(spark, f"file://{tmp_path}/members/*.warc.gz", f"file://{tmp_path}/twice")  # members are read as well
        assert again.count() == len(self.PAGES)

    def test_streams_of_any_shape(self):
        record = b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: 5\r\n\r\nab\r\n\r\r\n\r\n"
        for data in (record * 3, gzip.compress(record * 3), gzip.compress(record) * 3, gzip.compress(record * 2)[:] + gzip.compress(record)):
            for piece in (1, 3, 1000):
                assert [r for _, r in warc.records(warc.inflated(io.BytesIO(data), piece))] == [record] * 3
        assert list(warc.records(warc.inflated(io.BytesIO(b"")))) == []
        for bad in (gzip.compress(record)[:-9], gzip.compress(record[:-1]), gzip.compress(b"WARC/1.1\r\n"), gzip.compress(b"no archive\r\n\r\n")):
            with pytest.raises((ValueError, KeyError)):
                list(warc.records(warc.inflated(io.BytesIO(bad))))

    def test_a_damaged_payload_is_refused(self, spark, tmp_path):
        warc.write_archives(self.frame(spark, [(1, "u", "y" * 200)]), f"file://{tmp_path}/whole")
        index = warc.normalise(spark, f"file://{tmp_path}/whole", f"file://{tmp_path}/members")
        (f,) = (tmp_path / "members").glob("*.warc.gz")
        f.write_bytes(gzip.compress(gzip.decompress(f.read_bytes()).replace(b"yyy", b"yzy", 1)))
        with pytest.raises(Exception, match="is not the one that was written|ends early|invalid"):
            warc.read_archives(index.withColumn("length", F.lit(f.stat().st_size).cast("long")), f"file://{tmp_path}/members").collect()

    def test_no_pages(self, spark):
        assert warc.archived(self.frame(spark, [])).count() == 0


def audited(docs, labels):
    """The audit by plain loops over (doc_id, text, source) and (doc_id, quality, toxic)."""
    good, toxic = ({d for d, *v in labels if v[k] == 1 and d is not None} for k in (0, 1))
    masks = []
    for doc, text, source in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = (len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), bool(re.search(r"[#$%&*|]", text)),
                 doc is not None and any(d is not None and d < doc and (t or "") == text for d, t, _ in docs))
        masks.append((doc, source or "", dict(zip("ABCDE", fails, strict=True))))
    out, total = Counter(), Counter()
    for order in permutations("ABCDE"):
        for doc, part, fails in masks:
            gone = False
            for step, f in enumerate(order, 1):
                at = (part, "".join(order), step)
                removed = fails[f] and not gone
                out[at, "redundant"] += fails[f] and gone
                gone = gone or fails[f]
                out[at, "kept"] += not gone
                out[at, "removed"] += removed
                out[at, "unique_fails"] += fails[f] and sum(fails.values()) == 1
                out[at, "good_lost"] += removed and doc in good
                out[at, "toxic_lost"] += removed and doc in toxic
                total[part, f] += removed
    return {(p, o, s, *(out[(p, o, s), c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")), total[p, o[s - 1]]) for p in {m[1] for m in masks} for o in map("".join, permutations("ABCDE")) for s in range(1, 6)}


class TestAudit:
    DOCS = "doc_id long, text string, source string, mask string, key long, n int"
    COLUMNS = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")

    def rows(self):
        r = random.Random(3)
        plain = [sentences(i, r.randint(20, 90)) for i in range(40)]
        texts = [*ODD, *plain, *plain[:9], *(t.upper() for t in plain[:5]), *(t + " #1 & more" for t in plain[5:12]), *([plain[3]] * 12), plain[4][:-1] + "X", "y" * 9000 + "a", "y" * 9000 + "b", "y" * 9000 + "a"]
        rows = [(i, t, (None, "", "web", "news")[i % 4]) for i, t in enumerate(texts)]
        return [*rows, (None, plain[0], "web"), (None, None, None), (2, "one", "web"), (7, plain[1], "web"), (100, plain[1], "web")]

    def test_equals_plain_loops(self, spark):
        rows, labels = self.rows(), [(i, i % 2, int(i % 3 == 0)) for i in range(0, 80, 2)] + [(4, 1, None), (None, 1, 1), (6, None, 1)]
        docs = spark.createDataFrame([(*r, "x", 1, 1) for r in rows], self.DOCS)
        marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
        for block in (filter_audit.BLOCK, 8):
            got = {tuple(r[c] for c in self.COLUMNS) for r in filter_audit.audit(docs, marks, block=block).collect()}
            assert got == audited(rows, labels)

    def test_hashes_that_collide_are_resolved_by_texts(self, spark, monkeypatch):
        monkeypatch.setattr(filter_audit, "_hash", lambda part: F.lit(7).cast("long"))
        rows = [r[:2] for r in self.rows()]
        got = filter_audit.duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id").collect()
        want = {d for d, t in rows if d is not None and any(e is not None and e < d and (u or "") == (t or "") for e, u in rows)}
        assert {r.doc_id for r in got} == want

    def test_refinement_drops_who_is_alone(self, spark):
        docs = spark.createDataFrame([(1, "abcd" * 9), (2, "abcd" * 9), (3, "abcd" * 8 + "abce"), (4, "zz")], "doc_id long, text string")
        size = F.length("text").cast("long")
        rows = docs.select("doc_id", size.alias("size"), filter_audit.blocks(F.col("text"), size, 8).alias("blocks"))
        assert {r.doc_id: len(r.blocks) for r in rows.collect()} == {1: 4, 2: 4, 3: 4, 4: 1}
        assert {r.doc_id for r in filter_audit.refined(rows).collect()} == {1, 2}

    def test_no_documents(self, spark):
        none = spark.createDataFrame([], "doc_id long, text string, source string")
        assert filter_audit.audit(none, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


class TestImportance:
    def plain(self, text):
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        return [*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))], len(w)

    def brute(self, docs, target, share=25, least=20):
        of = lambda texts: Counter(zlib.crc32(f.encode()) % 10000 for t in texts for f in self.plain(t)[0])
        s, t = of([x for _, x in docs]), of(target)
        gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10000) / ((s[b] + 1) * (t.total() + 10000))))
        out = []
        for doc, text in docs:
            f, words = self.plain(text)
            weight = sum(gain(zlib.crc32(x.encode()) % 10000) for x in f) // len(f) if f else 0
            h = int(hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
            out.append([doc, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words])
        fit = sorted((x for x in out if x[4] >= least), key=lambda x: (-x[3], x[0] is None, x[0] or 0, x[1]))
        rank = {id(x): k for k, x in enumerate(fit[: len(fit) * share // 100], 1)}
        return sorted(((*x[:4], rank.get(id(x))) for x in out), key=str)

    def test_equals_brute_force_whatever_the_chunks(self, spark):
        r = random.Random(5)
        texts = [*ODD, *(sentences(i, r.randint(1, 60)) for i in range(80)), "w " * 20, "w " * 19, "É" * 3000, " ".join("ab" * 300 for _ in range(30))]
        rows = [*enumerate(texts), (None, texts[20]), (11, texts[11]), (11, texts[11]), (12, texts[40])]
        target = [sentences(i, 30) for i in range(20)] + [None, ""]
        docs = spark.createDataFrame([(d, t, 1.0, "x", 5) for d, t in rows], "doc_id long, text string, score double, digest string, rank int")
        want = self.brute(rows, target)
        for words, long in ((importance.CHUNK, importance.LONG), (7, 50), (1, 0)):
            got = importance.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), words=words, long=long)
            assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
            assert sorted(map(tuple, got.collect()), key=str) == want

    def test_codes_of_three_words(self):
        texts = ["Aa b c dd É", "", None, "x" * 70000 + " y z", "1"]
        doc, bucket = importance.features(pa.array(texts), n=3, buckets=1 << 32)
        want = Counter()
        for i, t in enumerate(texts):
            w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").replace("A", "a"))
            want.update((i, zlib.crc32(" ".join(w[j : j + k]).encode())) for k in (1, 2, 3) for j in range(len(w) - k + 1))
        assert Counter(zip(doc.tolist(), bucket.tolist(), strict=True)) == want

    def test_empty_tables(self, spark):
        none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, sentences(1, 30))] * 8, "doc_id long, text string")
        assert importance.resample(none, some).count() == 0
        assert sorted(r.rank or 0 for r in importance.resample(some, none).collect()) == [0, 0, 0, 0, 0, 0, 1, 2]
