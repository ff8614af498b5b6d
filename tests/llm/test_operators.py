"""The training-data operators on small tables: brute force, round trips, and the cases that docstrings define."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import chat_format, gated_lm, itq, mixing, packing, pii, prob_minhash, quality, srs, unit_dedup
from ledgerloom.llm.components import components

DOCS = "doc_id long, text string, source string, extra string, score double, label int"


def docs(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, f"s{i % 3}" if i % 7 else None, "x", 0.5, 1) for i, t in enumerate(texts)], DOCS)


def sentences(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))


ODD = [None, "", "one", "one", " \n\t ", "ünïcödé ☃ text", "a " * 3000, sentences(1, 40000), "x" * 50000]


def test_components(spark):
    r = random.Random(0)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)] + [(5, 5)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {n: m for n, m in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


class TestQuality:
    def table(self, spark, n=600):
        texts = [sentences(i, 60) + "." if i % 5 else "BUY!! NOW!! | $$$ " * 20 for i in range(n)]
        labels = spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(0, n, 2)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
        return docs(spark, texts), labels

    def test_held_out_documents_are_told_apart(self, spark):
        d, labels = self.table(spark)
        rows = quality.score_quality(d, labels).collect()
        assert len(rows) == 600 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
        held = [r for r in rows if r.held_out]
        assert min(r.score for r in held if r.doc_id % 5) > max(r.score for r in held if r.doc_id % 5 == 0)
        assert all(r.predicted == (r.score >= 0.7) for r in rows)
        kept = quality.keep_good(d, labels)
        assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if r.predicted}

    def test_odd_texts_and_no_labels(self, spark):
        _, labels = self.table(spark)
        rows = quality.score_quality(docs(spark, ODD), labels.limit(0)).collect()
        assert [r.score for r in sorted(rows, key=lambda r: r.doc_id)][:4] == [0.0, 0.0, 0.5, 0.5]
        assert quality.score_quality(docs(spark, []), labels).count() == 0

    def test_null_and_repeated_ids(self, spark):
        d, labels = self.table(spark, 200)
        more = d.union(d.where("doc_id < 3")).union(d.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
        rows = quality.score_quality(more, labels).collect()
        assert len(rows) == 204 and [r.held_out for r in rows if r.doc_id is None] == [False]
        named = quality.with_quality(d, quality.train(d, labels))
        assert named.columns == [*d.columns, "score_"] and named.count() == 200

    def test_the_prior_is_found(self):
        r = np.random.default_rng(0)
        p, u = r.normal(2, 1, 4000), np.concatenate([r.normal(2, 1, 2800), r.normal(-4, 1, 1200)])
        assert abs(quality.estimated_prior(p, u) - 0.7) < 0.05


class TestPii:
    def brute(self, text):
        out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
        out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
            x = re.sub("[^0-9]", "", m.group())
            if 14 <= len(x) <= 19 and pii.luhn(x):
                out.append((m.start(), 2, m.end()))
        out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
        return [(s, pii.BASE[k], e) for s, k, e in sorted(out)]

    def test_base_spans_equal_the_patterns(self):
        r = random.Random(2)
        for _ in range(3000):
            text = "".join(r.choice("ab@@..+- ()0123456789%é") for _ in range(r.randint(0, 60)))
            assert pii.base_spans(text) == self.brute(text), text
        for text in ["4111 1111 1111 1111", "a@b.c@d.e.f", "1.2.3.4.5.6.7.8", "0000000255.1.1.1", "+1 (555) 123-4567 +"]:
            assert pii.base_spans(text) == self.brute(text)

    def test_generated_entities_are_found(self):
        model, hits, total, false = pii.trained(), 0, 0, 0
        for text, spans in pii.generated(300, 77):
            found = pii.all_spans(text, model)[1]
            hits, total, false = hits + sum(s in found for s in spans), total + len(spans), false + sum(s not in spans for s in found)
        assert hits >= 0.97 * total and false <= 0.03 * total

    def test_dynamic_programming_is_exact(self):
        model = pii.trained()
        text = "tel 555-123-4567 or 10.0.0.1"
        atoms = [m.span() for m in pii._ATOM.finditer(text)]
        segs = pii._segments(text, atoms, [True] * len(atoms))
        top = model.scores(model.rows(text, atoms, segs, "")).max(axis=1)

        def best(i):
            return 0.0 if i >= len(atoms) else max([best(i + 1)] + [top[k] + best(j) for k, (a, j) in enumerate(segs) if a == i])

        chosen = {(s, e) for s, _, e in model.decode(text, atoms, [True] * len(atoms), "")}
        got = sum(top[k] for k, (i, j) in enumerate(segs) if (atoms[i][0], atoms[j - 1][1]) in chosen)
        assert got == pytest.approx(best(0))
        z, p = pii.expectations(model.scores(model.rows(text, atoms, segs, "")), segs, len(atoms))
        assert np.isfinite(z) and (p >= 0).all() and (p <= 1 + 1e-9).all()

    def test_long_regions_are_decoded_in_pieces(self, monkeypatch):
        text = " ".join(["call +49 151 234 5678", "4111-1111 x9", "user7@mail.example.org", "secret=abcdef0123456789"] * 300)
        whole = pii.all_spans(text, pii.trained())
        monkeypatch.setattr(pii, "AT_ONCE", 50)
        assert pii.all_spans(text, pii.trained()) == whole and len(whole[1]) >= 600

    def test_odd_texts_and_redaction(self, spark):
        d = docs(spark, [*ODD, "mail a.b@example.com now, call +1 (555) 123-4567", "9" * 30000, "1.1 " * 20000])
        rows = {r.doc_id: r for r in pii.find_spans(d).collect()}
        assert rows[0].spans == "" and rows[0].base_sha256 == hashlib.sha256(b"").hexdigest() and rows[9].n_email == rows[9].n_phone == 1
        clean = pii.redact(d)
        assert clean.columns == d.columns and {r.doc_id: r.text for r in clean.collect()}[9] == "mail [EMAIL] now, call [PHONE]"
        assert pii.find_spans(docs(spark, [])).count() == 0


class TestChat:
    def test_round_trip(self, spark):
        bits = ["</s>", "[INST]", "[/INST]", "[AND]", "\\", "[ROLE]", "[:]", "[", "]", "<", "/s>", "é", "\n", " ", "ok"]
        r = random.Random(3)
        rows = [(c, t if r.random() < 0.9 else None, r.choice(["user", "assistant", "system", "to[:]ol", None]), r.choice([None, "".join(r.choice(bits) for _ in range(r.randint(0, 6)))]), 1) for c in range(40) for t in range(r.choice([1, 5, 600]))]
        rows += rows[:5]
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
        want = {}
        for c, t, role, text, _ in rows:
            want.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
        made = chat_format.format_chats(df).withColumn("turns", chat_format.read_chats(F.col("formatted"))).collect()
        assert len(made) == len(want)
        digest = {x.conv_id: x for x in chat_format.chat_digest(chat_format.format_chats(df)).collect()}
        for x in made:
            turns = [(role, text) for _, role, text in sorted(want[x.conv_id])]
            assert [(t.role, t.text) for t in x.turns] == turns
            mine = "".join(text for role, text in turns if role == "assistant")
            under = [x.formatted[s.start : s.start + s.length] for s in x.loss_spans]
            assert "".join(re.sub(r"(?s)\\(.)", r"\1", u) for u in under) == mine
            d = digest[x.conv_id]
            assert (d.n_turns, d.loss_chars, d.formatted_chars) == (len(turns), len(mine), len(x.formatted))
            assert d.loss_sha256 == hashlib.sha256(mine.encode()).hexdigest()
            assert d.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()

    def test_the_loss_comes_from_the_mask(self, spark):
        df = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "a[AND]b"), (1, 2, "assistant", "c")], "conv_id long, turn long, role string, text string")
        made = chat_format.format_chats(df)
        d = chat_format.chat_digest(made).first()
        assert (d.loss_chars, d.loss_sha256) == (8, hashlib.sha256(b"a[AND]bc").hexdigest())
        none = chat_format.chat_digest(made.withColumn("loss_spans", F.slice("loss_spans", 1, 0))).first()
        assert (none.loss_chars, none.loss_sha256) == (0, hashlib.sha256(b"").hexdigest())

    def test_empty(self, spark):
        assert chat_format.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


class TestMixing:
    def test_quotas_repeats_and_whole_epochs(self, spark):
        texts = [sentences(i, 20) for i in range(900)]
        d = spark.createDataFrame([(i, "hot" if i % 3 == 0 else f"s{i % 10}", t, 1) for i, t in enumerate(texts)], "doc_id long, source string, text string, epoch int")
        drawn = mixing.mixture(d, max_repeats=2.0).toPandas()
        plan = mixing.weights(mixing.counted(d, "doc_id", "source", "text"), max_repeats=2.0).toPandas().set_index("source")
        assert plan.weight.sum() == pytest.approx(1) and set(drawn.doc_id) == set(range(900))
        got = drawn.groupby("source").tokens.sum()
        assert all(abs(got[s] - q) <= 25 for s, q in plan.quota.items())
        assert drawn.groupby("doc_id").size().max() <= 2 and not drawn.duplicated(["doc_id", "epoch"]).any()
        assert (plan.quota / plan.total).max() == pytest.approx(2.0, rel=1e-4)
        assert mixing.mixed(d, max_repeats=2.0).count() == len(drawn) and mixing.mixed(d).columns == d.columns

    def test_entropy_target_and_budget(self, spark):
        d = spark.createDataFrame([(i, "ab"[i % 10 == 0], "w w w w") for i in range(200)], "doc_id long, source string, text string")
        w = mixing.weights(mixing.counted(d, "doc_id", "source", "text"), max_repeats=None, target_entropy=0.6, budget=100).toPandas()
        assert -(w.weight * np.log(w.weight)).sum() == pytest.approx(0.6, abs=1e-5) and w.quota.sum() == pytest.approx(100)

    def test_unreachable_entropy_is_refused(self, spark):
        d = spark.createDataFrame([(i, f"s{i % 8}", "w w w w") for i in range(80)], "doc_id long, source string, text string")
        rows = mixing.counted(d, "doc_id", "source", "text")
        with pytest.raises(ValueError, match="entropy"):
            mixing.weights(rows, max_repeats=None, target_entropy=0.5)
        w = mixing.weights(rows, max_repeats=None, target_entropy=float(np.log(8))).toPandas()
        assert np.allclose(w.weight, 1 / 8)

    def test_repeated_ids_are_drawn_as_often_as_in_the_mixture(self, spark):
        rows = [(1, "a", "x y"), (1, "b", "x y z"), (2, "a", "x"), (3, "b", "x y"), (3, "b", "x y"), (3, "b", "other text"), (None, "a", "x"), (4, None, "q"), (None, None, "r")] + [(i, "c", "w " * 30) for i in range(10, 40)]
        d = spark.createDataFrame(rows, "doc_id long, source string, text string")
        for how in ({}, {"max_repeats": 3.0}, {"budget": 300.0}):
            n = {(r.doc_id, r.source): r["count"] for r in mixing.mixture(d, **how).groupBy("doc_id", "source").count().collect()}
            got = {(r.doc_id, r.source): r["count"] for r in mixing.mixed(d, **how).groupBy("doc_id", "source").count().collect()}
            assert got == n
        whole = mixing.mixed(d)
        assert {tuple(r) for r in whole.collect()} == set(rows) and whole.columns == d.columns

    def test_blocks_equal_brute_force(self, spark, monkeypatch):
        """Whole and part epochs over many blocks against plain Python: quotas in order of block and place."""
        monkeypatch.setattr(mixing, "BLOCK", 100)
        d = spark.createDataFrame([(i, "abc"[min(2, i % 5)], "w " * (1 + i % 7)) for i in range(400)], "doc_id long, source string, text string")
        plan = {r.source: r for r in mixing.weights(mixing.counted(d, "doc_id", "source", "text"), max_repeats=1.7).collect()}
        drawn = mixing.mixture(d, max_repeats=1.7).collect()
        tokens = {i: 1 + i % 7 for i in range(400)}
        hashed = {(r.doc_id, r.epoch): r.h for e in range(4) for r in d.select("doc_id", F.lit(e).alias("epoch"), F.xxhash64(F.lit(mixing.SEED), F.lit(e).cast("int"), F.col("doc_id")).alias("h")).collect()}
        want = set()
        for s, p in plan.items():
            mine = [i for i in range(400) if "abc"[min(2, i % 5)] == s]
            want |= {(i, e) for i in mine for e in range(p.whole)}
            place = lambda i, n=p.blocks, e=p.whole: (min(int((hashed[i, e] / 2.0**64 + 0.5) * n), n - 1), hashed[i, e], i)
            total = 0
            for i in sorted(mine, key=place):
                if total >= p.rest:
                    break
                want.add((i, p.whole))
                total += tokens[i]
        assert {(r.doc_id, r.epoch) for r in drawn} == want and len(drawn) == len(want)

    def test_odd(self, spark):
        assert {r.doc_id for r in mixing.mixture(docs(spark, ODD)).collect()} == set(range(len(ODD)))
        assert mixing.mixture(docs(spark, [])).count() == 0


class TestVectors:
    def vectors(self, n=700, width=16, seed=0):
        r = np.random.default_rng(seed)
        x = r.standard_normal((n, width))
        x[100:160] = x[100] + 0.12 * r.standard_normal((60, width))
        x[200:230] = x[200]
        return x.astype(np.float32)

    def frame(self, spark, x):
        rows = [(i, [float(v) for v in row], i % 2 if i >= 300 else 1, "x") for i, row in enumerate(x)]
        rows += [(9001, None, 1, "x"), (9002, [0.0] * 16, 1, "x"), (9003, [float("nan")] * 16, 1, "x"), (9004, [1.0, None], 1, "x"), (9005, rows[100][1], None, "x"), (9006, [1.0, 2.0], 1, "x"), (9007, [], 1, "x")]
        return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, gid string")

    def test_itq_finds_the_links_of_brute_force(self, spark, monkeypatch):
        x = self.vectors()
        u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
        label = np.array([i % 2 if i >= 300 else 1 for i in range(len(x))])
        near = (u @ u.T >= 0.93) & (label[:, None] == label[None])
        np.fill_diagonal(near, False)
        got = {r.vec_id: r for r in itq.near_vectors(self.frame(spark, x)).collect()}
        assert len(got) == len(x) + 7 and all(got[i].n_links == 0 and got[i].kept for i in range(9001, 9008))
        assert sum(got[i].n_links for i in range(len(x))) >= 0.99 * near.sum() and all(got[i].n_links <= near[i].sum() for i in range(len(x)))
        assert [got[i].component_id for i in range(200, 230)] == [200] * 30
        assert itq.near_vectors(self.frame(spark, x).limit(0)).count() == 0
        monkeypatch.setattr(itq, "BLOCK", 40)  # buckets are split into blocks
        split = {r.vec_id: (r.n_links, r.component_id) for r in itq.near_vectors(self.frame(spark, x)).collect()}
        assert split == {i: (r.n_links, r.component_id) for i, r in got.items()}
        twice = itq.near_vectors(self.frame(spark, x).where("vec_id in (200, 500, 9001)").union(self.frame(spark, x).where("vec_id in (200, 9001)"))).collect()
        assert sorted((r.vec_id, r.n_links, r.component_id) for r in twice) == [(200, 1, 200), (200, 1, 200), (500, 0, 500), (9001, 0, 9001), (9001, 0, 9001)]

    @pytest.mark.parametrize("width, common", [(64, 0.0), (64, 0.8), (64, 0.9), (24, 0.8), (128, 0.5)])
    def test_itq_keeps_its_recall_under_a_common_mean(self, spark, width, common):
        r = np.random.default_rng(2)
        mean = np.zeros(width)
        mean[0] = common**0.5
        base = r.standard_normal((400, width))
        x = mean + (1 - common) ** 0.5 * base / np.linalg.norm(base, axis=1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        x = np.concatenate([x, itq.partners(x, 0.94, r)])
        near = x @ x.T >= 0.93
        np.fill_diagonal(near, False)
        rows = spark.createDataFrame([(i, [float(v) for v in row], 1) for i, row in enumerate(x)], "vec_id long, embedding array<double>, label int")
        got = itq.near_vectors(rows).collect()
        assert sum(g.n_links for g in got) >= 0.99 * near.sum() and all(g.n_links <= near[g.vec_id].sum() for g in got)

    def test_itq_of_few_and_of_equal_vectors(self):
        for x in (np.ones((1, 8)), np.ones((5, 8)), np.eye(3), np.array([[1.0, 0.001], [1.0, -0.001]])):
            model = itq.ItqTables(x, 5)
            assert len(model.tables) >= 1 and model.keys(model.codes(x)).shape == (len(x), len(model.tables))

    def test_itq_counts_vectors_of_one_id_apart(self, spark):
        r = np.random.default_rng(4)
        far = [(i, [float(v) for v in r.standard_normal(32)], 1) for i in range(100, 150)]
        v, w = (r.standard_normal(32) for _ in range(2))
        rows = [(1, v.tolist(), 1), (1, w.tolist(), 1), (2, (v + 0.001).tolist(), 1), *far]
        got = itq.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
        assert sorted((g.vec_id, g.n_links, g.component_id) for g in got if g.vec_id < 3) == [(1, 0, 1), (1, 1, 1), (2, 1, 1)]
        assert all(g.n_links == 0 and g.kept for g in got if g.vec_id >= 100)

    def test_srs_recall_and_exact_scores(self, spark):
        x = self.vectors(1500)
        rows = srs.nearest(self.frame(spark, x).where("vec_id <> 9005")).orderBy("query_id", "rank").collect()
        by = {}
        for r in rows:
            by.setdefault(r.query_id, []).append(r)
        pool = x.astype(float)
        hits = total = 0
        for q, got in by.items():
            d = np.sqrt(((pool - pool[q]) ** 2).sum(axis=1))
            d[q] = np.inf
            want = np.lexsort((np.arange(len(d)), d))[:10]
            hits, total = hits + len(set(want) & {r.vec_id for r in got}), total + 10
            assert [r.rank for r in got] == list(range(1, 11)) and np.allclose([r.score for r in got], d[[r.vec_id for r in got]], atol=1e-12)
            if q == 200:
                assert [r.vec_id for r in got] == list(range(201, 211))
        assert len(by) == 15 and hits / total >= 0.9
        assert sum(g[0].verified for g in by.values()) < 0.8 * 15 * len(x)
        few = srs.nearest(self.frame(spark, x).where("vec_id < 4")).collect()
        assert sorted((r.query_id, r.rank) for r in few) == [(0, 1), (0, 2), (0, 3)]
        assert srs.nearest(self.frame(spark, x).limit(0)).count() == 0

    def test_srs_skips_rows_and_splits_cells(self, spark):
        r = np.random.default_rng(3)
        centres = 6 * r.standard_normal((20, 32))
        x = (centres[np.arange(4000) % 20] + r.standard_normal((4000, 32))).astype(np.float32)
        rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(100, [0.0] * 31 + [1e3]), (5, [1.0, 2.0]), (200_000, [1.0, 2.5])]
        found = srs.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), block=150, cells=8).collect()
        pool, hits = x.astype(float), 0
        queries = [q for q in range(0, 4000, 100) if q != 100]
        for q in queries:
            d = np.sqrt(((pool - pool[q]) ** 2).sum(axis=1))
            d[q] = np.inf
            hits += len(set(np.argsort(d)[:10]) & {f.vec_id for f in found if f.query_id == q})
        verified = {f.query_id: f.verified for f in found}
        share = sum(verified[q] for q in queries) / len(queries) / len(x)
        assert hits >= 0.9 * 10 * len(queries) and share < 0.3, (hits, share)
        assert [(f.rank, f.vec_id, f.score) for f in found if f.query_id == 200_000] == [(1, 5, 0.5)]  # each length on its own
        assert len({(f.query_id, f.rank) for f in found}) == len(found)

    def test_chi_square(self):
        assert srs.chi2_quantile(0.95, 8) == pytest.approx(15.5073, abs=1e-3)


class TestPacking:
    def check(self, spark, texts):
        from tokenizers import Tokenizer

        want = [e.ids + [2] for e in Tokenizer.from_file(packing.default_tokenizer()).encode_batch([t or "" for t in texts], add_special_tokens=False)]
        p = packing.pack(docs(spark, texts)).toPandas()
        assert set(p.doc_id) == set(range(len(texts)))
        for doc, g in p.sort_values("start").groupby("doc_id"):
            at = 0
            for r in g.itertuples():
                assert r.start == at and r.doc_tokens == len(want[doc])
                assert r.ids_crc32 == zlib.crc32(np.array(want[doc][at : at + r.length], "<u4").tobytes())
                at += r.length
            assert at == len(want[doc])
        for _, g in p.sort_values("offset").groupby("sequence_id"):
            assert list(g.offset) == list(np.cumsum(g.length) - g.length)
            n = g.length.sum()
            assert n <= 4096 and n & (n - 1) == 0
        return p

    def test_every_id_once(self, spark):
        self.check(spark, [*ODD, "A<|endoftext|>B", "it's, e.g. x.,y ...", *[sentences(i, 30 * i) for i in range(60)]])
        assert packing.pack(docs(spark, [])).count() == 0

    def test_shards_ranges_and_carried_pieces(self, spark, monkeypatch):
        monkeypatch.setattr(packing, "RANGE", 30_000)
        monkeypatch.setattr(packing, "SHARD", 7_000)
        p = self.check(spark, [sentences(i % 50, 20 * (i % 50)) for i in range(150)])
        assert p.sequence_id.map(lambda x: x >> 36).nunique() > 1
        full = p.groupby("sequence_id").length.sum()
        assert (full == 4096).sum() >= p.length.sum() // 4096 - p.sequence_id.map(lambda x: x >> 36).nunique()

    def test_other_tokenizers_are_refused(self):
        import public_tokenizers

        packing.WordTokens(packing.default_tokenizer())
        others = [f for f in os.listdir(os.path.dirname(packing.default_tokenizer())) if f.endswith(".json") and f != "word_bpe_49k.json"]
        refused = 0
        for name in others:
            try:
                packing.WordTokens(public_tokenizers.path(name))
            except ValueError:
                refused += 1
            except Exception:  # not a file of this library
                refused += 1
        assert refused == len(others)

    def test_neighbours_follow_their_seed(self):
        ids = [np.arange(100 * g, 100 * g + 50) for g in range(6) for _ in range(3)]
        n = np.array([len(i) for i in ids])
        df = np.full(1 << 16, 3.0)
        shard = packing.Shard(np.concatenate(ids), n, np.log1p((18 - df + 0.5) / (df + 0.5)), n.mean())

        def follow(seed, used):
            s = np.where(used, 0, shard.scores(seed))
            return np.argsort(-s, kind="stable")[: int((s > 0).sum())]

        full, left = packing.sequences(n, follow, window=150)
        assert not left and all(len({d // 3 for d, _, _ in seq}) == 1 for seq in full)
        brute = [sum(np.log1p((18 - 3 + 0.5) / 3.5) * 2.2 / (1 + 1.2) for _ in range(50)) if d // 3 == 0 else 0 for d in range(18)]
        assert np.allclose(shard.scores(0), brute)


class TestUnits:
    def brute(self, texts, least=unit_dedup.LEAST):
        """The spans by plain Python: units, units taken together, first occurrences, growth, union of overlapping spans."""
        units, words = {}, {}
        for i, text in enumerate(texts):
            ws = [(m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text or "")]
            low = lambda a, b, s=text: re.sub("[A-Z]", lambda m: m.group().lower(), s[a:b])
            words[i], units[i], now = [(a, b, low(a, b)) for a, b in ws], [], []
            for k, (a, b) in enumerate(ws):
                now.append(k)
                if text[b - 1] in ".!?" or k + 1 == len(ws) or "\n" in text[b : ws[k + 1][0]]:
                    units[i].append(now)
                    now = []
        seen, again = {}, []
        for i in sorted(units):
            for k in range(len(units[i])):
                key, j = [], k
                while j < len(units[i]) and sum(map(len, key)) < least:
                    key.append(tuple(words[i][x][2] for x in units[i][j]))
                    j += 1
                if sum(map(len, key)) >= least:
                    here = (i, k, j - 1)
                    kept = seen.setdefault(tuple(key), here)
                    if kept != here:
                        again.append((here, kept))
        runs = []
        for (i, k, j), kept in again:
            if runs and runs[-1][0][0][0] == i and runs[-1][-1][0][1] == k - 1:
                runs[-1].append(((i, k, j), kept))
            else:
                runs.append([((i, k, j), kept)])
        spans = {}
        for run in runs:
            (i, k, _), (ki, kk, kj) = run[0]
            (_, _, _), (li, _, lj) = run[-1]
            j = max(x[0][2] for x in run)
            a, b = words[i][units[i][k][0]][0], words[i][units[i][j][-1]][1]
            floor = words[ki][units[ki][kj][-1]][1] if ki == i else 0
            if k and kk:
                for x, y in zip(units[i][k - 1][::-1], units[ki][kk - 1][::-1]):
                    if words[i][x][2] != words[ki][y][2] or words[i][x][0] < floor:
                        break
                    a = words[i][x][0]
            if run[-1][0][2] == j and j + 1 < len(units[i]) and lj + 1 < len(units[li]):
                for x, y in zip(units[i][j + 1], units[li][lj + 1]):
                    if words[i][x][2] != words[li][y][2]:
                        break
                    b = words[i][x][1]
            spans.setdefault(i, []).append((a, b))
        out = set()
        for i, found in spans.items():
            now = None
            for a, b in sorted(found):
                if now and a < now[1]:
                    now = (now[0], max(now[1], b))
                else:
                    out |= {(i, *now)} if now else set()
                    now = (a, b)
            out.add((i, *now))
        return out

    def spans(self, spark, texts):
        return {(r.doc_id, r.start, r.end) for r in unit_dedup.repeated_spans(docs(spark, texts)).collect()}

    def test_passages_within_sentences_are_caught_whole(self, spark):
        passage = ". ".join(sentences(50 + i, 9).capitalize() for i in range(7)) + ". " + sentences(70, 5)
        texts = [f"{sentences(i, 30)} {passage} {sentences(100 + i, 30)}" if i % 4 == 1 else sentences(200 + i, 80) for i in range(40)]
        spans = unit_dedup.repeated_spans(docs(spark, texts)).collect()
        assert {r.doc_id for r in spans} == {i for i in range(40) if i % 4 == 1 and i > 1} and {r.kept_doc_id for r in spans} == {1}
        assert all(passage in texts[r.doc_id][r.start : r.end] for r in spans)
        clean = {r.doc_id: r for r in unit_dedup.without_repeats(docs(spark, texts)).collect()}
        assert all(len(clean[r.doc_id].text) == len(texts[r.doc_id]) - (r.end - r.start) for r in spans) and clean[0].text == texts[0]

    def test_passages_of_short_lines_are_caught(self, spark):
        passage = "\n".join(sentences(900 + i, 4) for i in range(15))
        texts = [f"{sentences(i, 20)}\n{passage}\n{sentences(100 + i, 20)}" for i in range(5)]
        assert self.spans(spark, texts) == {(i, texts[i].index(passage), texts[i].index(passage) + len(passage)) for i in range(1, 5)}

    def test_spans_equal_brute_force(self, spark, data):
        r = random.Random(9)
        pool = [sentences(300 + i, r.randint(1, 12)) + r.choice([".", "!", "\n", "\n\n", " "]) for i in range(60)]
        texts = [*ODD, *[" ".join(r.choice(pool) for _ in range(r.randint(1, 25))).replace("a", r.choice("aaaA"), 1) for _ in range(120)]]
        assert self.spans(spark, texts) == self.brute(texts)
        some = [x.text for x in spark.read.parquet(f"{data}/documents.parquet").orderBy("doc_id").collect()]
        assert self.spans(spark, some) == self.brute(some)

    def test_odd(self, spark):
        line = "this very line comes twice here"
        rows = unit_dedup.repeated_spans(docs(spark, [*ODD, f"é\n{line}\nq\n{line}"])).collect()
        assert [(r.doc_id, r.start, r.end) for r in rows] == [(9, 4 + len(line) + 1, 4 + 2 * len(line) + 1)]
        assert unit_dedup.repeated_spans(docs(spark, [])).count() == 0
        twice = spark.createDataFrame([(1, line), (1, line), (None, line), (2, f"x. {line}")], "doc_id long, text string")
        assert [(r.doc_id, r.start, r.end) for r in unit_dedup.repeated_spans(twice).collect()] == [(2, 3, 3 + len(line))]
        clean = unit_dedup.without_repeats(docs(spark, [f"{line}.", f"x y z. {line}. end"])).collect()
        assert sorted(r.text for r in clean) == [f"{line}.", "x y z.  end"]


class TestLm:
    def test_base_score_and_counts_are_exact(self, spark):
        texts = [*ODD, *[sentences(i % 5, 50) for i in range(80)]]
        words = lambda t: [w for w in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))] + ["\n"]
        rows = {r.doc_id: r for r in gated_lm.score_texts(docs(spark, texts), head=100).collect()}
        counts = Counter()
        for i, t in enumerate(texts):
            if zlib.crc32(str(i).encode()) % 7 != 2:
                counts.update(words(t))
        n, v = sum(counts.values()), len(counts)
        for i, t in enumerate(texts):
            ws, r = words(t), rows[i]
            assert r.n_tokens == len(ws) and r.train_tokens == n and r.n_known == sum(counts[w] > 0 for w in ws)
            assert r.base_score == pytest.approx(sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in ws), rel=1e-9)
            assert np.isfinite(r.score) and r.score < 0
        assert gated_lm.score_texts(docs(spark, [])).count() == 0

    def test_every_training_document_teaches_the_network(self, spark):
        ids = spark.range(200).where("pmod(xxhash64(id, 3), 8) <> 0 and crc32(cast(cast(id as string) as binary)) % 7 <> 2").limit(20)
        d = ids.select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab cd ef gh "), 60).alias("text"))
        told, taught = ({r.doc_id: r.score for r in gated_lm.score_texts(d, rounds=n).collect()} for n in (0, gated_lm.ROUNDS))
        assert len(told) == 20 and all(taught[k] > told[k] + 1 for k in told)

    def test_held_out_texts_are_likelier_than_by_counts(self, spark, data):
        d = spark.read.parquet(f"{os.path.dirname(data)}/sf0.01/documents.parquet").select("doc_id", "text")
        sums = gated_lm.score_texts(d).groupBy("held_out").agg(F.sum("score"), F.sum("base_score"), F.count("*")).collect()
        assert len(sums) == 2 and all(s[1] > s[2] for s in sums)

    def test_a_score_is_the_sum_over_its_tokens(self):
        """Step by step, token by token, without batches, against score_docs."""
        words = ["\n"] + [f"w{i}" for i in range(1300)]
        vocab = gated_lm.Vocabulary(words, np.arange(1301, 0, -1) + 3, 900_000, 2000)
        r = np.random.default_rng(2)
        model = gated_lm.Gru(vocab)
        model.ww, model.wc = r.standard_normal(model.ww.shape).astype(np.float32), r.standard_normal(model.wc.shape).astype(np.float32)
        sizes = [1, 150, 7, 40]
        at, off = r.integers(-1, 1301, sum(sizes)), np.concatenate(([0], np.cumsum(sizes)))
        got = gated_lm.score_docs(model, vocab, at, off)
        sym, cls, place = vocab.codes(at)
        sigmoid = lambda x: 1 / (1 + np.exp(-x))
        for d in range(4):
            h, last, total = np.zeros(16), len(model.x) - 1, 0.0
            for k in range(off[d], off[d + 1]):
                x, g = model.x[last].astype(float), h @ model.u
                z, q = sigmoid(x[:16] + g[:16]), sigmoid(x[16:32] + g[16:32])
                h = (1 - z) * np.tanh(x[32:] + q * g[32:]) + z * h
                a = h @ model.wc + model.bc
                total += a[cls[k]] - np.log(np.exp(a).sum())
                if place[k] >= 0:
                    rows = slice(cls[k] * gated_lm.WIDTH, (cls[k] + 1) * gated_lm.WIDTH)
                    b = model.ww[rows] @ h + model.bw[rows]
                    total += b[place[k]] - np.log(np.exp(b).sum())
                total += np.log(10) * (vocab.inside[at[k]] if at[k] >= 0 else 0.0)
                last = sym[k]
            assert got[d] == pytest.approx(total / np.log(10), rel=1e-4)

    def test_probabilities_sum_to_one(self):
        words = ["\n"] + [f"w{i}" for i in range(1300)]
        vocab = gated_lm.Vocabulary(words, np.arange(1301, 0, -1) + 3, 900_000, 2000)
        model = gated_lm.Gru(vocab, 4)
        r = np.random.default_rng(1)
        model.ww, model.wc = r.standard_normal(model.ww.shape).astype(np.float32), r.standard_normal(model.wc.shape).astype(np.float32)
        at = np.arange(-1, 1301)
        _, cls, place = vocab.codes(at)
        h = np.repeat(r.standard_normal((1, 4)), len(at), axis=0).astype(np.float32)
        p = np.exp(model.log_probs(h, cls, place).astype(float)) * np.where(at >= 0, 10 ** vocab.inside[at], 1.0)
        assert p.sum() == pytest.approx(1, abs=1e-4)

    def test_gradients(self):
        vocab = gated_lm.Vocabulary(["\n"] + [f"w{i}" for i in range(1300)], np.arange(1301, 0, -1), 900_000, 2000)
        m, r = gated_lm.Gru(vocab, 4), np.random.default_rng(0)
        for k in m.NAMES:
            setattr(m, k, getattr(m, k).astype(float) + 0.1 * r.standard_normal(getattr(m, k).shape) * (k in ("wc", "ww")))
        s, c, w = (x.reshape(5, 3).astype(int) for x in vocab.codes(r.integers(-1, 1301, 15)))
        s[2, 1] = len(m.x) - 1
        h = r.standard_normal((3, 4))
        _, g, _ = m.gradient(s, c, w, h)
        for k in m.NAMES:
            a = getattr(m, k)
            i = np.unravel_index(np.argmax(np.abs(g[k])), a.shape)
            old, got = a[i], []
            for d in (1e-5, -1e-5):
                a[i] = old + d
                got.append(m.gradient(s, c, w, h)[0])
            a[i] = old
            assert g[k][i] == pytest.approx((got[0] - got[1]) / 2e-5 / 15, rel=1e-4)


class TestMinhash:
    def test_estimates_probability_jaccard(self):
        r = np.random.default_rng(0)
        e = r.integers(1, 1 << 48, 300).astype(np.uint64)
        wa, wb = r.integers(1, 5, 300), r.integers(1, 5, 300)
        a, b = slice(0, 220), slice(60, 300)
        doc = np.concatenate([np.zeros(220, int), np.ones(240, int)])
        sig = prob_minhash.prob_minhash(doc, np.concatenate([e[a], e[b]]), np.concatenate([wa[a], wb[b]]), 2, registers=4000)
        p, q = np.zeros(300), np.zeros(300)
        p[a], q[b] = wa[a] / wa[a].sum(), wb[b] / wb[b].sum()
        exact = sum(1 / np.maximum(p / p[d], q / q[d]).sum() for d in range(300) if p[d] and q[d])
        assert abs((sig[0] == sig[1]).mean() - exact) < 0.03

    def test_classes_equal_brute_force(self, spark):
        r = random.Random(4)
        texts = []
        for i in range(40):
            base = sentences(i, 120).split()
            for _ in range(r.choice([1, 1, 3, 8])):
                w = list(base)
                for _ in range(r.choice([0, 1, 2, 30])):
                    w[r.randrange(len(w))] = "zz" + str(r.random())[2:6]
                texts.append(" ".join(w))
        texts += ["same short", "same short", "Same  SHORT"]
        grams = [{tuple(t.lower().split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for t in texts]
        root = list(range(len(texts)))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for i in range(len(texts)):
            for j in range(i):
                if len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j]):
                    x, y = find(i), find(j)
                    root[max(x, y)] = min(x, y)
        d = docs(spark, texts)
        got = {r.doc_id: r.class_id for r in prob_minhash.near_duplicates(d).collect()}
        assert got == {i: find(i) for i in range(len(texts))}
        split = {r.doc_id: r.class_id for r in prob_minhash.near_duplicates(d, block=3, star=2).collect()}  # blocks and stars split
        assert split == got
        kept = prob_minhash.deduplicate(d)
        assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {i for i in range(len(texts)) if find(i) == i}

    def test_odd(self, spark):
        rows = prob_minhash.near_duplicates(docs(spark, [*ODD, *ODD])).collect()
        got = {r.doc_id: r.class_id for r in rows}
        assert len(rows) == 18 and got[0] == 0 and got[9] == 9 and got[4] == 4 and got[13] == 13 and {got[i] for i in (2, 3, 11, 12)} == {2} and got[16] == 7
        assert prob_minhash.near_duplicates(docs(spark, [])).count() == 0

    def test_failed_rows_meet_all_members_of_their_bucket(self, spark):
        base = [f"w{i}" for i in range(400)]
        texts = [" ".join(base[: 400 - 3 * i]) for i in range(60)]  # far ends of the chain fail with the leader
        members = spark.createDataFrame([(1, i, i > 20) for i in range(60)] + [(2, i, False) for i in range(9)], "key long, rep long, failed boolean")
        met = prob_minhash._meetings(members, 7).collect()
        pairs = {(x.rep, y.rep) for x in met if x.failed for y in met if not y.failed and (x.key, x.fi, x.ai) == (y.key, y.fi, y.ai)}
        assert pairs == {(i, j) for i in range(21, 60) for j in range(60)} and len(met) <= 39 * 9 + 60 * 6
        got = {r.class_id for r in prob_minhash.near_duplicates(docs(spark, texts), block=5, star=4).collect()}
        assert got == {0}

    def test_null_and_repeated_ids(self, spark):
        text = sentences(3, 50)
        rows = [(1, text), (1, text), (2, text), (None, text), (3, sentences(4, 50))]
        got = prob_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sorted((r.doc_id or 0, r.class_id or 0, r.kept) for r in got) == [(0, 0, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True)]

    def test_pairs_of_equal_sets_meet_whatever_their_counts(self, spark):
        texts = [" ".join([sentences(i, 304), *[sentences(1000 + i, 10)] * n]) for i in range(12) for n in (100, 5)]
        got = {r.doc_id: r.class_id for r in prob_minhash.near_duplicates(docs(spark, texts)).collect()}
        assert got == {i: i - i % 2 for i in range(24)}
