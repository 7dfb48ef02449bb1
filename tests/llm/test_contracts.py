"""The registered queries on the driver's smallest tables, against brute force on their contract columns."""

import hashlib
import os
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from tessera.llm import pseudo, queries
from tessera.llm.histpack import shortest_pack_first
from tessera.llm.tokens import path

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def packed(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


def test_op2(spark, texts):
    tok = Tokenizer.from_file(path("byte_bpe_50k.json"))
    got = queries.op2_histogram_packing(spark, SF).collect()
    want, lengths = set(), Counter()
    for doc, text in texts.items():
        ids = [*tok.encode(text, add_special_tokens=False).ids, 1]
        for at in range(0, len(ids), 2048):
            piece = ids[at : at + 2048]
            want.add((doc, at, len(piece), zlib.crc32(packed(piece)), len(ids)))
            lengths[len(piece)] += 1
    assert {(r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got} == want and len(got) == len(want)
    held = {}
    for r in got:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    patterns = Counter()
    for spans in held.values():
        spans.sort()
        assert [o for o, _ in spans] == [sum(n for _, n in spans[:i]) for i in range(len(spans))]
        patterns[tuple(n for _, n in spans)] += 1
    assert patterns == Counter(dict(shortest_pack_first(lengths, 2048)))
    # longest first, each into the shortest pack so far; where none has room, all that is left of the length begins packs
    packs = []
    for n in sorted(lengths, reverse=True):
        for left in range(lengths[n], 0, -1):
            shortest = min(range(len(packs)), key=packs.__getitem__, default=None)
            if shortest is None or packs[shortest] + n > 2048:
                packs += [n] * left
                break
            packs[shortest] += n
    assert Counter(packs) == Counter(sum(p) for p in patterns.elements())


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def test_op3(spark, texts):
    for r in queries.op3_secret_links(spark, SF).collect():
        text = texts[r["doc_id"]]
        base = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
        base += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
        base += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == kind for k, *_ in base) for kind in ("assign", "access", "hex")]
        base.sort(key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))
        joined = [f"{k}:{s}:{e}" for k, s, e in base]
        assert r["base_sha256"] == hashlib.sha256(",".join(joined).encode()).hexdigest()
        assert not set(joined) - set(r["spans"].split(","))


def test_op6(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    got = {}
    for r in queries.op6_kmeans_tree(spark, sf).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
        assert r["recall"] >= 0.9 and 0 < r["visited"] <= 1
    assert sorted(got) == sorted(ids[ids % 20 == 0])
    at, hits = {i: k for k, i in enumerate(ids)}, 0
    for q, found in got.items():
        found.sort()
        scores = x @ x[at[q]]
        assert [f[0] for f in found] == list(range(1, 21))
        assert all(abs(s - scores[at[v]]) < 1e-9 for _, v, s in found) and [f[1] for f in found] == [v for _, v in sorted((-s, v) for _, v, s in found)]
        best = sorted((i for i in ids if i != q), key=lambda i: (-scores[at[i]], i))[:20]
        hits += len(set(best) & {v for _, v, _ in found})
    assert hits / (20 * len(got)) >= 0.9


def test_op7(spark, texts):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = queries.op7_quality_outliers(spark, "/root/testdata/sf0.01").collect()
    good = [r for r in rows if labels.get(r["doc_id"]) == 1 and not r["base_failed"]]
    bad = [r for r in rows if labels.get(r["doc_id"]) == 0]
    assert sum(r["kept"] for r in good) >= 0.97 * len(good) and sum(not r["kept"] for r in bad) >= 0.85 * len(bad)
    for r in queries.op7_quality_outliers(spark, SF).collect():
        text = texts[r["doc_id"]]
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        many = Counter(windows)
        repeated = {j for i, w in enumerate(windows) if many[w] > 1 for j in range(i, i + 8)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated))
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert r["base_failed"] == (len(words) < 20 or 100 * len(repeated) > 30 * len(words)) and not (r["base_failed"] and r["kept"])


def test_op8(spark, texts):
    tok = Tokenizer.from_file(path("word_bpe_49k.json"))
    got = queries.op8_transducer_bpe(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = tok.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        decoded = tok.decode(ids, skip_special_tokens=False)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(packed(ids)).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


def test_op9(spark, texts):
    tok = Tokenizer.from_file(path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    assert {r["doc_id"]: r["n_tokens"] for r in queries.op9_separator_scan(spark, SF).collect()} == {d: len(tok.encode(t, add_special_tokens=False).ids) for d, t in texts.items()}


def test_op10(spark, texts):
    """Scores are the sum of each word's log-probability given both sides, one window at a time, in double precision."""
    net = pseudo.Network()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    known = pseudo.vocabulary(docs, "text", net)
    indexed = pseudo.materialize(pseudo.index(docs, known), "test")
    model = pseudo.train_on(indexed, known)
    p = {k: v.astype(float) for k, v in model[1].items()}
    words = pseudo.Words(known, net)
    for r in pseudo.score_on(indexed, model).orderBy("doc_id").limit(40).collect():
        ids = [0] * net.side + [words[w] for w in pseudo.words_of(texts[r["doc_id"]])] + [0] * net.side
        total = 0.0
        for i in range(net.side, len(ids) - net.side):
            around = [*ids[i - net.side : i], *ids[i + 1 : i + 1 + net.side]]
            h = np.tanh(np.concatenate([p["emb"][j] for j in around]) @ p["w"] + p["b"])
            group, inside = divmod(ids[i], net.per_class)
            for z, at in ((h @ p["uc"] + p["bc"], group), (h @ p["uw"][group] + p["bw"][group], inside)):
                total += z[at] - np.log(np.exp(z).sum())
        assert r["n_words"] == len(ids) - 2 * net.side and abs(r["pseudo_log_likelihood"] - total) < 1e-3 * max(1, r["n_words"])
    got = queries.op10_pseudo_likelihood(spark, SF).collect()
    assert len(got) == len(texts) and all((r["n_words"] == 0) == (r["mean_log_probability"] is None) for r in got)
