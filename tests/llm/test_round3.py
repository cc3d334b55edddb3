"""Prefix trie, fill-in-middle and the quality network: brute force, round trips, gradients, held-out labels, awkward rows."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from rastrel.llm import fim, mixing, pii, prefix_trie, quality_net, quality_rules, queries, sharding

SF = "/root/testdata/sf0.001"
NASTY = ["pos", "_part", "_n", "depth", "n", "form", "output", "score", "quality", "_h", "bytes", "own", "h", "base", "ka"]


@pytest.fixture(scope="module")
def corpus_texts():
    return [r[0] for r in duckdb.sql(f"SELECT text FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()]


# ---- 11 ------------------------------------------------------------------------------------------------------------
def brute_trie(rows):
    """Nodes of the rebuilt conversations by dictionaries; ties of turn by role and the digest of role and text."""
    talks = collections.defaultdict(list)
    for c, turn, role, text in rows:
        role, text = role or "", text or ""
        said = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
        talks[c].append(((turn is not None, turn or 0, role, said), (role, text)))
    talks = {c: [m for _, m in sorted(t)] for c, t in talks.items()}
    made = {}
    for c, own in talks.items():
        h = zlib.crc32(str(c).encode()) % 9 if c is not None else 0
        base = talks.get(c - (abs(c) % 5) * (1 if c >= 0 else -1), []) if c is not None else []
        made[c] = base[:h] + own[h:]
    members, kids = collections.defaultdict(list), collections.defaultdict(set)
    for c, m in made.items():
        for d in range(len(m) + 1):
            members[tuple(m[:d])].append(c)
            if d:
                kids[tuple(m[: d - 1])].add(tuple(m[:d]))
    least = lambda ids: min((i for i in ids if i is not None), default=None)
    leaves, saved = collections.Counter(), collections.Counter()
    for node, ids in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not kids[node]
            saved[node[:d]] += (len(ids) - 1) * len(node[-1][1].encode()) if node else 0
    out = []
    for node, ids in members.items():
        ends = ",".join(map(str, sorted(i for i in ids if i is not None and len(made[i]) == len(node))))
        up = least(members[node[:-1]]) if node else None
        out.append((least(ids), len(node), up, len(ids), len(kids[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie_rows(spark, rows):
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select("*", *[F.lit("x").alias(c) for c in NASTY])
    return sorted((tuple(r) for r in prefix_trie.conversation_trie(d).select(COLUMNS).collect()), key=str)


def test_trie_against_brute_force(spark):
    rng = random.Random(4)
    said = ["", "ok", "no", "Ünï 北京", "x" * 5000]
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice(said)) for c in range(-12, 60) if rng.random() < 0.9 for t in range(rng.randint(1, 14))]
    rows += [(c, t, "user", "same") for c in range(100, 220) for t in range(3)]  # a large group of copies
    rows += [(300, 0, "user", f"turn {i % 3}") for i in range(150)] + [(301, t, "user", "long") for t in range(120)]  # one turn number, a deep path
    assert trie_rows(spark, rows) == brute_trie(rows)


def test_trie_on_awkward_rows(spark):
    rows = [(1, None, None, None), (1, None, None, None), (1, 2, "a", None), (None, 0, "a", "b"), (None, 1, None, "c"), (2, 5, "", ""), (2**62, 0, "a", "b"), (-(2**62), 0, "a", "z" * 50_000), (6, 0, "a", "only"), (7, None, "b", "t"), (7, 0, "b", "t")]
    assert trie_rows(spark, rows) == brute_trie(rows)
    assert trie_rows(spark, []) == []


def test_sums_double_along_a_path(spark):
    n = 700  # ⌈log2⌉ rounds, not n
    nodes = spark.range(n + 1).selectExpr("id as ka", "0L as kb", "case when id > 0 then id - 1 end as pa", "case when id > 0 then 0L end as pb", "id as v")
    got = {r["ka"]: r["v"] for r in prefix_trie.subtree_sums(nodes, ["v"]).collect()}
    assert got == {i: sum(range(i, n + 1)) for i in range(n + 1)}


def test_end_digests_run_over_batches():
    import pyarrow as pa

    ids = [(1, 1, i) for i in range(1000)] + [(1, 2, 5), (2, 1, -3), (2, 1, 4)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*ids[lo : lo + 70], strict=True)], ["ka", "kb", "conv_id"]) for lo in range(0, len(ids), 70)]
    got = [r for b in prefix_trie._end_digests(iter(batches)) for r in b.to_pylist()]
    want = {(1, 1): ",".join(map(str, range(1000))), (1, 2): "5", (2, 1): "-3,4"}
    assert {(r["ka"], r["kb"]): r["ends_sha256"] for r in got} == {k: hashlib.sha256(v.encode()).hexdigest() for k, v in want.items()} and len(got) == 3


# ---- 12 ------------------------------------------------------------------------------------------------------------
TEXTS = [None, "", "a", "\n", "\n\n", "a\nb", "a\nb\n", "no <P> here\nx", "two\n<M>\n", "Ünï\n北京 😀\nend", "\r\n x\n\ty", "<\nS>\n<", "word " * 40_000 + "\nlast", "x\n" * 3_000]


def texts_table(spark, texts):
    rows = [(i if i != 1 else None, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[:4], "doc_id long, text string").select("*", *[F.lit("x").alias(c) for c in NASTY])


def brute_fim(doc_id, text, fim_percent=100, spm_percent=50, units=r"[^\n]*\n|[^\n]+"):
    text = text or ""
    u = re.findall(units, text)
    s = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(s[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= fim_percent:
        return len(u), "plain", None, None, text
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    p, m, z = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if h[3] % 100 < spm_percent:
        return len(u), "spm", len(p), len(m), f"<S>{z}<P>{p}<M>{m}"
    return len(u), "psm", len(p), len(m), f"<P>{p}<S>{z}<M>{m}"


@pytest.mark.parametrize(("unit", "pattern", "percent"), [("line", r"[^\n]*\n|[^\n]+", 100), ("word", r"[^\x20\x09-\x0d]+[\x20\x09-\x0d]*|[\x20\x09-\x0d]+", 60), ("char", r"(?s).", 30)])
def test_fill_in_middle_against_brute_force(spark, unit, pattern, percent):
    d = texts_table(spark, TEXTS)
    s = fim.Settings(unit=unit, fim_percent=percent)
    got = collections.Counter((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in fim.fill_in_middle(d, s).collect())
    assert got == collections.Counter((r["doc_id"], *brute_fim(r["doc_id"], r["text"], percent, units=pattern)) for r in d.collect())


def test_restored_texts_are_the_texts(spark):
    d = texts_table(spark, TEXTS)
    back = fim.fill_in_middle(d, keep=("doc_id", "text")).where(~fim.restored(F.col("output"), F.col("form")).eqNullSafe(F.coalesce("text", F.lit(""))))
    assert back.count() == 0
    assert fim.digest(d.where("false")).count() == 0


def test_boundaries():
    assert fim.boundaries(fim.codepoints("a b\n c"), "word").tolist() == [0, 2, 5, 6]
    assert fim.boundaries(fim.codepoints("a\n\nb"), "line").tolist() == [0, 2, 3, 4]
    assert fim.boundaries(fim.codepoints(""), "line").tolist() == [0]


# ---- 13 ------------------------------------------------------------------------------------------------------------
def test_convolution_gradient():
    rng = np.random.default_rng(0)
    net = quality_net.Network.fresh(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, size, first, count = quality_net.chunked([bytes(rng.integers(97, 110, n, dtype=np.uint8)) for n in (30, 700, 5, 300)])
    y, w = np.array([1, 0, 1, 0]), np.array([0.1, 0.4, 0.2, 0.3])
    _, grad = net.gradient(x, size, first, count, y, w)
    for name, g in grad.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        kept, e = net.p[name][at], 1e-4
        net.p[name][at] = kept + e
        up, _ = net.gradient(x, size, first, count, y, w)
        net.p[name][at] = kept - e
        down, _ = net.gradient(x, size, first, count, y, w)
        net.p[name][at] = kept
        assert (up - down) / (2 * e) == pytest.approx(g[at], rel=0.03, abs=1e-5), name


def test_every_window_of_a_text_is_in_a_chunk():
    for n in (0, 1, 7, 8, 255, 256, 257, 504, 505, 506, 5000):
        raw = bytes(i % 251 for i in range(n))
        x, size, first, count = quality_net.chunked([b"first", raw])
        mine, sizes = x[first[1] :], size[first[1] :]
        seen = [bytes(c[i : i + 8]) for c, s in zip(mine, sizes, strict=True) for i in range(s - 7)]
        assert seen == [raw[i : i + 8] for i in range(n - 7)] and len(mine) == count[1]


def test_scores_do_not_depend_on_neighbours():
    net = quality_net.Network.fresh(1)
    texts = ["", None, "a", "some words\n" * 400, "x" * 256, "é" * 300]
    together = quality_net.probabilities(net, texts)
    assert together == pytest.approx([quality_net.probabilities(net, [t])[0] for t in texts])
    # against loops: the largest response over every window of the text
    raw = ("some words\n" * 400).encode()
    p = net.p
    r = np.array([np.concatenate([p["e"][b] for b in raw[i : i + 8]]) @ p["w"] + p["b"] for i in range(len(raw) - 7)])
    x, size, first, _ = quality_net.chunked([raw])
    pooled, _ = net.pooled(net.responses(x, size)[0], size, first)
    assert pooled[0, : quality_net.FILTERS] == pytest.approx(np.maximum(r.max(0), 0), rel=1e-4, abs=1e-5)


def test_quality_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in queries.QUERIES["op13_quality_net"](spark, sf).collect()}
    labels = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{sf}/labels.parquet'").fetchall())
    assert len(got) == 1000 and all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for i, r in got.items())
    held = [(r["predicted"], labels[i]) for i, r in got.items() if r["held_out"] and i in labels]
    assert sum(p == q for p, q in held) / len(held) > 0.93
    assert np.mean([p for p, q in held if q]) > 0.95


def test_quality_net_on_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(quality_net, "SAMPLE_ROWS", 40)
    docs = texts_table(spark, [*TEXTS, *[f"good text {i} with words" for i in range(60)], *[f"BAD {i} $$$ ### !!!" * 9 for i in range(60)]])
    labels = [(i, 1) for i in range(14, 74)] + [(i, 0) for i in range(74, 134)] + [(14, 1), (80, 1), (None, 0), (2, None), (3, 9), (9999, 1)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int").select("*", F.lit("x").alias("text"), F.lit(1).alias("score"))
    rows, found = quality_net.sample(docs, labels, 1)
    assert found == {0: 60, 1: 60} and collections.Counter(k for k, _ in rows) == {0: 20, 1: 20}
    net = quality_net.train(docs, labels)
    out = quality_net.score(docs, net, keep=("doc_id", "text"))
    assert out.count() == docs.count()
    by_text = collections.defaultdict(set)
    for r in out.collect():
        by_text[r["text"] or ""].add(round(r["score"], 6))
    assert all(len(v) == 1 for v in by_text.values())
    assert quality_net.train(docs, labels.where("quality = 1")) is None and quality_net.train(docs.where("false"), labels) is None
    assert {r["score"] for r in quality_net.score(docs, None).collect()} == {0.5}
    assert quality_net.score(docs.where("false"), net).count() == 0


def test_registered():
    assert {"op11_prefix_trie", "op12_fill_in_middle", "op13_quality_net"} <= set(__spark_entry__.queries())
    assert {"op11_prefix_trie", "op12_fill_in_middle"} <= set(__spark_entry__.oracle_sql())


# ---- mends of 1 and 4 ----------------------------------------------------------------------------------------------
SECRETS = ["Password=hunter22a", "password: tr0ub4dor", "password = swordfish9", 'token="abcdef99"', "API_KEY=ABCDEFGH", 'TOKEN = "9233A8ECF7C5B09F"', '{"secret": "abc/def.ghi"}', "client_secret := s3cr3t-value", "ghp_0123456789abcdefghij0123456789abcdef", "eyJhbGciOiJIUzI1.eyJzdWIiOiIxMjM0.SflKxwRJSMeKKF2"]
HELD = ["hunter22a", "tr0ub4dor", "swordfish9", "abcdef99", "ABCDEFGH", "9233A8ECF7C5B09F", "abc/def.ghi", "s3cr3t-value", "0123456789abcdefghij", "eyJzdWIiOiIxMjM0"]


def test_secrets_in_all_their_forms(spark):
    d = spark.createDataFrame(list(enumerate(SECRETS)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.pseudonymise(d, "k").collect()}
    assert all(got[i]["n_private"] == 1 and h not in got[i]["text"] and len(got[i]["text"]) == len(SECRETS[i]) for i, h in enumerate(HELD))
    prose = ["the password: understanding is key", "my secrets are: nothing", "tokenizers: bytes1234", "secret: 12"]
    left = spark.createDataFrame([(t,) for t in prose], "text string")
    assert [r["text"] for r in pii.pseudonymise(left, "k").collect()] == prose


def test_no_secret_of_the_given_documents_stays(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    given = r"(?i)(?:password|token|secret|api_key)[\"']?\s*[=:]\s*[\"']?([A-Za-z0-9+/_-]{6,})"
    found = docs.select("doc_id", "text", F.regexp_extract_all("text", F.lit(given), F.lit(1)).alias("held")).where("size(held) > 0")
    assert {2514, 8743} <= {r["doc_id"] for r in found.select("doc_id").collect()}
    out = pii.pseudonymise(found, "k")
    assert out.where(F.exists("held", lambda h: F.contains(F.col("text"), h)) | (F.col("n_private") == 0)).count() == 0


def test_a_day_is_one_day_in_every_form(spark):
    days = spark.sql("SELECT id AS doc_id, date_add(DATE'1900-01-01', CAST(id * 97 AS INT)) AS day FROM range(750)")
    text = F.concat_ws(" ", F.date_format("day", "yyyy-MM-dd"), F.date_format("day", "dd.MM.yyyy"), F.when(F.dayofmonth("day") > 12, F.date_format("day", "dd/MM/yyyy")).otherwise(F.date_format("day", "MM/dd/yyyy")))
    rows = pii.pseudonymise(days.select("doc_id", text.alias("text")), "k").collect()
    seen = set()
    for r in rows:
        iso, dots, slashes = r["text"].split()
        y, m, d = iso.split("-")
        assert dots == f"{d}.{m}.{y}" and slashes == (f"{d}/{m}/{y}" if int(d) > 12 else f"{m}/{d}/{y}") and r["n_private"] == 3
        seen.add(iso)
    assert len(seen) == 750


def test_a_mix_does_not_depend_on_layout(spark):
    rows = [(None if i % 5 < 3 else 7, f"text {i} " + "w " * (i % 9), "en", "src1", i) for i in range(1500)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    take = lambda n: sorted(map(str, mixing.mix(d.repartition(n), budget=2500, keep=("text", "lang", "source", "n_chars")).collect()))
    assert take(3) == take(7) != []


def test_shards_do_not_depend_on_layout(spark):
    rows = [(None if i % 4 == 0 else i % 90, "copy" if i % 3 == 0 else f"text {i % 70}") for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    place = lambda n: sorted(map(str, sharding.shard_documents(d.repartition(n), 6).drop("law").collect()))
    one = place(2)
    assert one == place(5)
    shards = collections.Counter(r.split("shard=")[1].split(",")[0] for r in one)
    assert sum(shards.values()) == 400 and max(shards.values()) - min(shards.values()) <= 1


def test_shards_keep_groups_together(spark):
    """Few edges are cut: groups that fit into a shard are whole, but for what the counts' law takes."""
    rows = [(i, f"group {i % 60}" if i < 240 else f"alone {i}") for i in range(600)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 6).collect()
    where = collections.defaultdict(collections.Counter)
    for r in got:
        if r["doc_id"] < 240:
            where[r["doc_id"] % 60][r["shard"]] += 1
    uncut = sum(n * (n - 1) // 2 for c in where.values() for n in c.values())
    assert uncut >= 0.9 * 60 * 6


def test_places_beyond_the_short_form(spark, corpus_texts, monkeypatch):
    d = spark.createDataFrame(list(enumerate(corpus_texts)), "doc_id long, text string")
    want = sorted(map(tuple, quality_rules.statistics(d).collect()))
    monkeypatch.setattr(quality_rules, "POS_BITS", 4)  # texts of 16 words or more take the long form
    assert sorted(map(tuple, quality_rules.statistics(d).collect())) == want


def test_rules_do_not_repeat_the_base(spark):
    labels = [(i, int(i >= 60)) for i in range(120)]
    text = lambda i: ("again and again " * 30) if i < 30 else (f"w{i} $$$ " + " ".join(f"x{i}y{j}" for j in range(60)) + " $$$ ###" * 20 if i < 60 else " ".join(f"a{i}b{j}" for j in range(70)))
    docs = spark.createDataFrame([(i, text(i)) for i in range(120)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in quality_rules.judge(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    assert all(got[i]["base_failed"] and not got[i]["kept"] for i in range(30)) and all(got[i]["rule"] > 0 for i in range(30, 60)) and all(got[i]["kept"] for i in range(60, 120))
