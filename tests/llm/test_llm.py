"""Corpus operators against brute force, round trips and held-out accuracy, and on awkward rows."""

import collections
import hashlib
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from rastrel.llm import chat, fingerprints, graph, langid, lm_scoring, mixing, near_dedup, packing, pii, quality_rules, queries, sharding
from rastrel.llm.subwords import Subwords

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0d]+")
NASTY = ["part", "token", "row", "n", "_bucket", "shard", "n_words", "epoch", "a", "b", "node", "label", "score", "ids"]


@pytest.fixture(scope="module")
def corpus():
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall())


@pytest.fixture(scope="module")
def awkward(spark):
    long = " ".join(f"word{i % 700}" for i in range(9000))
    rows = [(1, None), (2, ""), (3, "a"), (4, long), (5, long), (5, long), (6, " \t\n"), (7, "Ünï <\\s> [INST] 北京 <|endoftext|>"), (None, "no id here at all"), (8, "12 34"), (9, "a")]
    d = spark.createDataFrame([(i, t, None if i == 1 else "en", None if i == 2 else "src3", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return d.select("*", *[F.lit("x").alias(c) for c in NASTY])


@pytest.fixture(scope="module")
def nothing(awkward):
    return awkward.where("false")


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def shingle_set(text, k):
    w = WORD.findall(lower(text))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_components(docs, k, num, den):
    sets = {i: shingle_set(t, k) for i, t in docs.items()}
    root = {i: i for i in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(docs)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and find(i) != find(j) and den * len(a & b) >= num * len(a | b):
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


# ---- 5 -------------------------------------------------------------------------------------------------------------
def test_near_duplicates_against_all_pairs(spark, corpus):
    rng = random.Random(1)
    docs = dict(corpus)
    base = [w for w in WORD.findall(max(corpus.values(), key=len))[:150]]
    for i in range(120):  # one hot group of near copies, some of which only link with others of it
        w = list(base)
        for _ in range(rng.randint(0, 12)):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
        docs[10_000 + i] = " ".join(w)
    for i in range(40):
        docs[20_000 + i] = docs[10_000 + rng.randrange(120)]
    d = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(d, 3, 85, 100).collect()}
    assert got == brute_components(docs, 3, 85, 100)


def test_hot_lists_are_cut_into_blocks(spark):
    rng = random.Random(2)
    base = [f"w{i}" for i in range(60)]
    docs = {}
    for i in range(200):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(60)] = f"e{rng.randrange(10**6)}"
        docs[i] = " ".join(w)
    d = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(d, 3, 85, 100, block=16).collect()}
    assert got == brute_components(docs, 3, 85, 100)
    sig = np.frombuffer(b"".join(near_dedup.signature(near_dedup.shingles(t, 3)).tobytes() for t in docs.values()), np.uint32).reshape(-1, 64)
    assert ((sig[0] == sig).sum(1) > 10).all()


def test_near_duplicates_on_awkward_rows(spark, awkward, nothing):
    out = near_dedup.near_duplicates(awkward).collect()
    assert len(out) == 11 and near_dedup.near_duplicates(nothing).count() == 0
    by = collections.defaultdict(list)
    for r in out:
        by[r["doc_id"]].append(r)
    assert {r["component_id"] for r in by[5]} == {4} and by[1][0]["n_shingles"] == by[2][0]["n_shingles"] == by[6][0]["n_shingles"] == 0
    assert by[9][0]["component_id"] == 3 and by[1][0]["kept"] and by[None][0]["component_id"] is None


def test_components_of_a_long_path(spark):
    n = 300
    order = list(range(n))
    random.Random(3).shuffle(order)
    e = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(1000, 1001)], "a long, b long")
    got = {r["node"]: r["component"] for r in graph.components(e).collect()}
    assert {got[i] for i in range(n)} == {0} and got[1001] == 1000


# ---- 6 -------------------------------------------------------------------------------------------------------------
def test_packing_is_an_exact_cut(spark, corpus, awkward, nothing):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(packing.default_tokenizer())
    rows = awkward.where("doc_id is not null").dropDuplicates(["doc_id"]).select("doc_id", "text").unionByName(spark.createDataFrame([(i + 100, t) for i, t in corpus.items()], "doc_id long, text string"))
    texts = {r["doc_id"]: r["text"] for r in rows.collect()}
    want = {i: [*own.encode(t or "", add_special_tokens=False).ids, 2] for i, t in texts.items()}
    pieces = packing.pack(rows, window=512).collect()
    got, at = collections.defaultdict(dict), collections.defaultdict(list)
    for p in pieces:
        got[p["doc_id"]][p["start"]] = np.frombuffer(bytes(p["ids"]), "<u4").tolist()
        at[p["sequence_id"]].append((p["offset"], p["length"]))
        assert p["doc_tokens"] == len(want[p["doc_id"]])
    assert {i: sum((x[s] for s in sorted(x)), []) for i, x in got.items()} == want
    for s, cuts in at.items():
        cuts.sort()
        assert [o for o, _ in cuts] == np.cumsum([0, *[n for _, n in cuts]])[:-1].tolist()
        assert sum(n for _, n in cuts) == 512 or s == max(at)
    assert packing.pack(nothing).count() == 0 and packing.pack(awkward).where("start = 0").count() == 11


def test_cached_pieces_equal_the_tokenizer():
    s = Subwords(packing.default_tokenizer())
    texts = ["a\xa0b \xb2\xbd\xaa\xba_x__ éà's “q”—r…", "It's 12 o'clock!!", "ÀÉß ıİ Σας", "a​b ﬁ 'll 'S 's", "x<|endoftext|>y", "été́", "\x1c\x85 a", "ll'llve"]
    assert s.encode(texts) == [s._own(t) for t in texts]


# ---- 3 -------------------------------------------------------------------------------------------------------------
def test_chat_reads_back_what_went_in(spark):
    odd = ["</s>[INST] ok [/INST]", "<\\s>", "<\\\\/s>[\\SEP]", "", "[SEP][SEP]", "a<", "/s>", "[[INST]]", "\\", None]
    rows = [(1, i, "assistant" if i % 3 else "user", t) for i, t in enumerate(odd)] + [(2, 0, None, "x"), (2, 0, None, "x"), (None, None, "<s>", "[/INST]")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("head", F.lit(1)).withColumn("s", F.lit(2))
    back = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in chat.read_back(chat.format_conversations(d)).collect()}
    assert back[1] == [(r, t or "") for _, _, r, t in rows[:10]]
    assert back[2] == [("", "x"), ("", "x")] and back[None] == [("<s>", "[/INST]")]
    dig = {r["conv_id"]: r for r in chat.digest(d).collect()}
    said = "".join(t or "" for _, _, r, t in rows[:10] if r == "assistant")
    assert dig[1]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest() and dig[1]["loss_chars"] == len(said)
    assert chat.digest(d.where("false")).count() == 0


# ---- 4 -------------------------------------------------------------------------------------------------------------
def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def test_pseudonyms_keep_format_and_links(spark):
    values = {"4111 1111 1111 1111": "card", "378282246310005": "card", "192.168.0.1": "ip", "2024-02-29": "date", "31.12.1999": "date", "+1 (319) 555-5132": "phone", "DE89 3704 0044 0532 0130 00": "iban", "078-05-1120": "ssn", "jo.doe@mail.example.com": "email"}
    stay = ["4111 1111 1111 1112", "999.1.1.1", "2023-02-29", "1.2.3.4.5", "000-12-3456", "version 2.0", "DE88370400440532013000"]
    rows = [(i, f"See {v}, then again {v}. Bye") for i, v in enumerate(values)] + [(100 + i, f"keep {v} here") for i, v in enumerate(stay)]
    out = {r["doc_id"]: r for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    for i, (v, kind) in enumerate(values.items()):
        a, b = re.fullmatch(r"See (.*), then again (.*)\. Bye", out[i]["text"]).groups()
        assert a == b != v and out[i]["n_private"] == 2, v
        if kind != "email":
            assert re.sub(r"\d", "0", a) == re.sub(r"\d", "0", v) or kind == "ip"
        if kind == "card":
            assert luhn(re.sub(r"\D", "", a)) and a[0] == v[0]
        if kind == "iban":
            x = a.replace(" ", "")
            assert int(x[4:] + "1314" + x[2:4]) % 97 == 1
        if kind == "ip":
            assert all(0 <= int(p) < 256 for p in a.split("."))
    for i, v in enumerate(stay):
        assert out[100 + i]["text"] == f"keep {v} here" and out[100 + i]["n_private"] == 0


def test_pseudonyms_of_lettered_ibans_and_spaced_phones(spark):
    ibans = ["GB82WEST12345698765432", "NL91ABNA0417164300", "FR14 2004 1010 0505 0001 3M02 606", "MT84MALT011000012345MTLCAST001S", "NO93 8601 1117 947", "BE68 5390 0754 7034 THEN"]
    phones = ["+44 20 7946 0958", "+49 30 901820", "+1 319 555 5132", "319 555 5132", "+44.20.7946.0958", "+442079460958", "+49 30 901820 2024-02-29"]
    stay = ["GB83WEST12345698765432", "120 130 1400", "+12 34"]
    rows = list(enumerate(f"See {v} here" for v in [*ibans, *phones, *stay]))
    out = [r["text"][4:-5] for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "k").orderBy("doc_id").collect()]
    form = lambda v: re.sub("[A-Z]", "A", re.sub(r"\d", "0", v))
    for v, a in zip([*ibans, *phones], out):
        assert a != v and form(a) == form(v), (v, a)
    for v, a in zip(ibans, out):
        x = a.replace(" ", "").removesuffix("THEN")
        assert a[:2] == v[:2] and int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1, (v, a)
        assert v[4:-5] not in a and a.endswith("THEN") == v.endswith("THEN")
    assert out[6].startswith("+44 ") and out[len(ibans) + len(phones) :] == stay


def test_what_stands_for_a_secret_is_hashed(spark):
    secrets = ["password=1234567890123", "secret=2024-13-45", "password=999.1.1.1", "api_key=000-12-3456", "secret=jo@mail.example.com", 'token = "4111111111111111', "password=DE89370400440532013000", "api_key=+1 x"]
    d = spark.createDataFrame(list(enumerate(f"set {v}\" now" for v in secrets)), "doc_id long, text string")
    out = [r for r in pii.pseudonymise(d, "k").orderBy("doc_id").collect()]
    for v, r in zip(secrets[:-1], out):
        name, value = re.match(r"(.*?= ?\"?)(.*)", v).groups()
        new = re.fullmatch(re.escape("set " + name) + r"([0-9a-f]+)\" now", r["text"])[1]
        assert r["n_private"] == 1 and len(new) == len(value) and new != value, v
    assert out[-1]["n_private"] == 0  # too short for a secret
    other = pii.pseudonymise(d, "another").orderBy("doc_id").first()
    assert other["text"] != out[0]["text"]


def test_pseudonyms_link_forms_and_never_collide(spark):
    one = ["+15551234567", "(555) 123-4567", "555-123-4567", "+1 555 123 4567", "1 555 223 4567"]
    out = [r["text"] for r in pii.pseudonymise(spark.createDataFrame(list(enumerate(one)), "doc_id long, text string"), "k").orderBy("doc_id").collect()]
    ten = [re.sub(r"\D", "", t)[-10:] for t in out]
    assert len(set(ten[:4])) == 1 and ten[4] != ten[0]
    for form, step in (("MM/dd/yyyy", 7), ("dd/MM/yyyy", 7), ("dd.MM.yyyy", 11), ("yyyy-MM-dd", 11)):
        days = spark.range(0, 73_000, step).select(F.col("id").alias("doc_id"), F.date_format(F.date_add(F.to_date(F.lit("1900-01-01")), F.col("id").cast("int")), form).alias("text"))
        made = pii.pseudonymise(days, "k").join(days.withColumnRenamed("text", "old"), "doc_id").collect()
        read = lambda t: ("d" if int(t[:2]) > 12 else "m") if "/" in t else ""
        assert len({r["text"] for r in made}) == len({r["old"] for r in made}) and all(read(r["text"]) == read(r["old"]) and r["n_private"] == 1 for r in made), form


def test_feistel_is_a_permutation(spark):
    d = spark.range(17 * 23).select(pii.feistel(F.col("id") % 17, F.lit(17), F.floor(F.col("id") / 17), F.lit(23), "k", "t").alias("s"))
    got = {(r["s"]["x"], r["s"]["y"]) for r in d.collect()}
    assert len(got) == 17 * 23 and max(x for x, _ in got) == 16 and max(y for _, y in got) == 22


def test_pseudonyms_on_awkward_rows(awkward, nothing):
    out = pii.pseudonymise(awkward.withColumn("_private", F.lit(1)), "k")
    again = pii.pseudonymise(out, "k")
    assert out.columns == [*awkward.columns, "_private", "n_private"] == again.columns and again.count() == out.count() == 11
    assert out.where("doc_id = 1 and text is null and n_private = 0").count() == 1 and pii.pseudonymise(nothing, "k").count() == 0


# ---- 7 -------------------------------------------------------------------------------------------------------------
def test_quality_statistics_and_rules(spark, corpus, awkward, nothing):
    extra = {10**6: "a b c a b c a b c", 10**6 + 1: "x\nx\n \nx y\nx", 10**6 + 2: None, 10**6 + 3: "q q q q"}
    d = spark.createDataFrame(list({**corpus, **extra}.items()), "doc_id long, text string")
    for r in quality_rules.statistics(d).collect():
        t = {**corpus, **extra}[r["doc_id"]] or ""
        w = WORD.findall(t)
        seen = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        again = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again)), r["doc_id"]
    labels = spark.createDataFrame([(1, 1), (1, 1), (4, None)], "doc_id long, quality int")
    assert quality_rules.judge(awkward, labels).count() == 11 and quality_rules.judge(nothing, labels).count() == 0


def test_rules_hold_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    half = F.col("doc_id") % 2 == 0
    out = quality_rules.judge(docs, labels.where(half)).join(labels.where(~half), "doc_id").groupBy("quality", "kept").count().collect()
    n = {(r["quality"], r["kept"]): r["count"] for r in out}
    good = n.get((1, True), 0) / (n.get((1, True), 0) + n.get((1, False), 0))
    bad = n.get((0, False), 0) / (n.get((0, True), 0) + n.get((0, False), 0))
    assert good > 0.9 and bad > 0.6


# ---- 8 -------------------------------------------------------------------------------------------------------------
def test_gradient_through_time():
    rng = np.random.default_rng(0)
    net = langid.Network.fresh(["a", "b"], 1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y, w = rng.integers(0, 256, (5, 3)).astype(np.uint8), np.array([0, 1, 1]), np.array([0.2, 0.3, 0.5])
    _, grad = net.gradient(x, y, w)
    for name in ("wo", "unf", "ugb", "tgf"):
        i = tuple(n // 2 for n in net.p[name].shape) if name != "tgf" else (int(x[2, 1]), 3)
        loss = []
        for e in (1e-3, -2e-3):
            net.p[name][i] += e
            loss.append(net.gradient(x, y, w)[0])
        net.p[name][i] += 1e-3
        assert abs((loss[0] - loss[1]) / 2e-3 - grad[name][i]) < 2e-3


def test_language_of_held_out_documents(spark, awkward, nothing):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    net = langid.train(docs.where(langid.fold(3) != 1))
    held = langid.identify(docs.where(langid.fold(3) == 1), net, keep=("doc_id", "lang"))
    assert held.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98
    odd = {r["doc_id"]: r["lang_pred"] for r in langid.identify(awkward, net).collect()}
    assert odd[1] == odd[2] == odd[6] == odd[8] == "und" and langid.identify(nothing, net).count() == 0
    assert langid.train(nothing) is None
    # chunks of one text are labelled alone or together, whole or cut, with the same result
    a, b = "the and of with " * 100, "der die das und nicht"
    both = langid.label(net, [a, b, None])
    assert np.allclose(both[1][:2], [langid.label(net, [t])[1][0] for t in (a, b)], atol=1e-5) and both[0][2] == "und"


def test_every_language_is_sampled(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_ROWS", 40)
    rows = [(i, f"text number {i}", "rare" if i == 1234 else "ab"[i % 2]) for i in range(3000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.sample(d, 5)
    n = collections.Counter(got["lang"])
    assert n["rare"] == 1 and min(n["a"], n["b"]) > 15 and len(got) <= 40 and list(got.columns) == ["lang", "s0", "s1", "s2"]


# ---- 9 -------------------------------------------------------------------------------------------------------------
def test_fingerprints_and_block_tables(spark, corpus, awkward, nothing):
    out = {r["doc_id"]: r for r in queries.op9_fingerprints(spark, SF).collect()}
    ids = sorted(corpus)
    votes = {}
    for i in ids:
        t, n = corpus[i] or "", corpus[ids[(ids.index(i) + 1) % len(ids)]] or ""
        k = len(t) // 4
        assert out[i]["edited_sha256"] == hashlib.sha256((t[: len(t) - k] + n[:k]).encode()).hexdigest()
        votes[i] = int(out[i]["fingerprint"], 16)
    assert np.mean([r["near_edited"] > r["near_next"] for r in out.values()]) > 0.97
    for i in ids:
        if i % 20 == 0:
            assert out[i]["near_rows"] == sum(bin(votes[i] ^ votes[j]).count("1") <= 3 for j in ids) - 1
    fp = [random.Random(4).getrandbits(63) for _ in range(50)]
    fp += [x ^ (1 << (i % 60)) ^ (1 << (i % 7)) for i, x in enumerate(fp)] + [x ^ 0b11101 for x in fp]
    d = spark.createDataFrame([(x,) for x in set(fp)], "_fp long")
    got = {(r[0], r[1]) for r in fingerprints.hamming_search(d, d, 3).collect()}
    assert got == {(a, b) for a in set(fp) for b in set(fp) if bin(a ^ b).count("1") <= 3}
    assert fingerprints.fingerprint_documents(awkward).count() == 11 and fingerprints.fingerprint_documents(nothing).count() == 0


def test_simhash_votes(spark):
    text = "alpha beta gamma alpha beta"
    d = spark.createDataFrame([(text,)], "text string")
    h = [x & (2**64 - 1) for x in d.select(fingerprints.term_hashes(F.col("text"))).first()[0]]
    want = sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))
    assert fingerprints.simhash(d.withColumn("k", F.lit(1)), ["k"]).first()["_fp"] & (2**64 - 1) == want and len(h) == 4


# ---- 10 ------------------------------------------------------------------------------------------------------------
def test_shards(spark, corpus, awkward, nothing):
    docs = {**corpus, **{10**6 + i: "one text that many share" for i in range(90)}}
    out = sharding.shard_documents(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), shards=7).collect()
    at = collections.defaultdict(list)
    group = collections.defaultdict(set)
    for r in out:
        t = (docs[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(t) + 8, zlib.crc32(t), "rows", None)
        at[r["shard"]].append(r["slot"])
        group[t].add(r["shard"])
    n = [len(x) for x in at.values()]
    assert len(out) == len(docs) and len(at) == 7 and max(n) - min(n) <= 1 and all(sorted(x) == list(range(len(x))) for x in at.values())
    split = [len(s) for t, s in group.items()]
    assert max(split) <= 4 and np.mean(np.array(split) > 1) < 0.05
    assert sharding.shard_documents(awkward).count() == 11 and sharding.shard_documents(nothing).count() == 0


def test_large_groups_fill_whole_shards(spark):
    rows = [(i, "shared" if i < 4000 else f"pair {i // 2}" if i < 8000 else f"some {i % 9}" if i < 9000 else f"single {i}") for i in range(12000)]
    out = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    n, group = collections.Counter(r["shard"] for r in out), collections.defaultdict(set)
    for r in out:
        group[r["text_crc32"]].add(r["shard"])
    assert set(n.values()) == {500} and len(group[zlib.crc32(b"shared")]) == 8
    assert sum(len(x) > 1 for x in group.values()) < 20
    # a longer shard is used where it costs no whole one
    assert [b[3] for b in sharding._whole([(1, 1, 7)], [4, 4, 3, 3])] == [4, 3]
    assert [b[3] for b in sharding._whole([(1, 1, 6)], [4, 4, 3, 3])] == [3, 3]


def test_pairs_meet_without_free_room(spark):
    rows = [(i, f"pair {i // 2}") for i in range(6000)]
    out = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), shards=6).collect()
    group = collections.defaultdict(set)
    for r in out:
        group[r["text_crc32"]].add(r["shard"])
    assert set(collections.Counter(r["shard"] for r in out).values()) == {1000} and sum(len(x) > 1 for x in group.values()) < 60


# ---- 1 -------------------------------------------------------------------------------------------------------------
def test_shortages_go_to_siblings_first(spark):
    rows = [("web", "en", "s1", 1, 100), ("web", "en", "s2", 1, 1000), ("web", "de", "s3", 1, 1000), ("books", "en", "s4", 1, 1000)]
    leaves = spark.createDataFrame(rows, "domain string, lang string, source string, docs long, tokens long")
    plan = mixing.plan_budgets(leaves, 1400.0, 1, {"web": 0.5, "books": 0.5}, {"en": 0.6, "de": 0.4}, {})
    assert {r["source"]: r["budget"] for r in plan.collect()} == {"s1": 100, "s2": 320, "s3": 280, "s4": 700}
    plan = mixing.plan_budgets(leaves.where("source in ('s1', 's4')"), 900.0, 1, {"web": 0.5, "books": 0.5}, {"en": 1.0}, {})
    assert {r["source"]: r["budget"] for r in plan.collect()} == {"s1": 100, "s4": 800}


def test_mix_takes_seeded_prefixes(spark, awkward, nothing):
    out = queries.op1_mixing(spark, SF).toPandas()
    for _, leaf in out.groupby(["domain", "lang", "source"]):
        part = leaf[leaf.start_token.notna()].sort_values("start_token")
        assert part.start_token.tolist() == np.cumsum([0, *part.take_tokens])[: len(part)].tolist()
        assert (part.take_tokens[:-1] == part.n_tokens[:-1]).all()
    assert mixing.mix(awkward).count() > 0 and mixing.mix(nothing).count() == 0


# ---- 2 -------------------------------------------------------------------------------------------------------------
HELD = "crc32(cast(cast(doc_id as string) as binary)) % 5 = 1"


def test_attention_gradient():
    rng = np.random.default_rng(0)
    m = lm_scoring.Model.fresh(np.ones(20, bool), np.full(20, 0.05), 1)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    m.p["b1"], m.p["bg"] = rng.standard_normal(m.p["b1"].shape), rng.standard_normal(m.p["bg"].shape)
    m.table = rng.dirichlet(np.ones(20), lm_scoring.EXPERTS).T
    x, y = rng.integers(0, 20, (2, lm_scoring.WINDOW)), rng.integers(0, 20, (2, lm_scoring.SCORED))
    on = np.ones(y.shape, bool)
    on[1, -3:] = False
    _, grad, _ = m.gradient(x, y, on)
    for name in ("e", "e2"):  # given by row
        used, g = grad[name]
        grad[name] = np.zeros((20, lm_scoring.WIDTH))
        grad[name][used] = g
    assert np.allclose(m.gates(x).reshape(2, lm_scoring.SCORED, -1) / m.gates(x).reshape(2, lm_scoring.SCORED, -1).sum(2, keepdims=True), m.forward(x)[0])
    m.folded = None
    for name in ("e", "e2", "q", "k", "v", "o", "w1", "w2", "g", "pos"):
        i = tuple(n // 2 for n in m.p[name].shape) if name not in ("e", "e2") else (int(x[1, 20]), 2)
        loss = []
        for step in (1e-4, -2e-4):
            m.p[name][i] += step
            loss.append(m.gradient(x, y, on)[0])
        m.p[name][i] += 1e-4
        assert abs((loss[0] - loss[1]) / 2e-4 - grad[name][i]) < 1e-4 + 0.02 * abs(grad[name][i]), name
    assert np.allclose(lm_scoring.CAUSAL[0, lm_scoring.WINDOW - lm_scoring.SCORED + 1 :], -1e9)  # no position sees what comes


def test_every_subword_is_scored_once(corpus):
    words = lm_scoring.Words([], lm_scoring.default_tokenizer())
    texts = [lm_scoring.words_of(t) for t in [None, "a", *list(corpus.values())[:20]]]
    tokens = np.array([len(t) + 1 for t in texts])
    laid = lm_scoring.Laid.of(words, words.slots(texts), tokens)
    ids = [[i for w in t for i in words.encoder.word(w)] + [words.encoder.end] for t in texts]
    assert sorted(laid.place.tolist()) == laid.place.tolist() and len(set(laid.place.tolist())) == len(laid.place) == sum(map(len, ids)) == laid.on().sum()
    assert laid.targets.ravel()[laid.place].tolist() == sum(ids, [])
    x, y = laid.windows(slice(None))
    lead = lm_scoring.WINDOW - lm_scoring.SCORED
    assert (x[:, lead + 1 :][laid.on()[:, 1:]] == y[:, :-1][laid.on()[:, 1:]]).all()  # the input is the id before
    at = np.flatnonzero(laid.place % lm_scoring.SCORED == 0)
    assert [x[laid.place[i] // lm_scoring.SCORED, lead] for i in at] == [sum(ids, [])[i - 1] if i not in np.cumsum([0, *map(len, ids)]) else words.encoder.end for i in at]


@pytest.fixture(scope="module")
def scored(spark, corpus):
    """Scores of the corpus, and the model and the corpus's statistics that gave them."""
    kept = []
    real = lm_scoring.observe
    with pytest.MonkeyPatch.context() as m:
        m.setattr(lm_scoring, "SAMPLE_ROWS", 40)
        m.setattr(lm_scoring, "HEAD_WORDS", 300)  # most words go through their own bucket
        m.setattr(lm_scoring, "observe", lambda *a: kept.append((a[1], *real(*a))) or kept[-1][1:])
        d = spark.createDataFrame(list(corpus.items()), "doc_id long, text string")
        out = lm_scoring.score_documents(d, HELD).collect()
    return out, kept[0]


def test_base_score_is_exact(corpus, scored):
    words = {i: [*WORD.findall(lower(t)), None] for i, t in corpus.items()}
    c = collections.Counter(w for i, x in words.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in x)
    n, v = sum(c.values()), len(c)
    assert sorted(r["doc_id"] for r in scored[0]) == sorted(corpus)
    for r in scored[0]:
        x = words[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(x), sum(w in c for w in x), n, zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1)
        assert abs(r["base_score"] - sum(np.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in x)) < 1e-6 * abs(r["base_score"])


def test_scores_against_brute_force(corpus, scored):
    """Every word by itself: the model's ids one window at a time by `forward`, and the unigram by a dictionary."""
    out, (head, stats, model) = scored
    encoder = lm_scoring.Encoder.load(lm_scoring.default_tokenizer())
    texts = {i: lm_scoring.words_of(t) for i, t in corpus.items()}
    teach = {i for i in texts if zlib.crc32(str(i).encode()) % 5 != 1}
    count = collections.Counter(w for i in teach for w in [*texts[i], b""])
    assert stats.tokens == sum(count.values()) and stats.counts[0] == len(teach)
    got = {r["doc_id"]: r["score"] for r in out}
    lead = lm_scoring.WINDOW - lm_scoring.SCORED
    for i in sorted(texts, key=lambda i: len(texts[i]))[:120]:
        each = [*[encoder.word(w) for w in texts[i]], [encoder.end]]
        ids = np.array(sum(each, []))
        p, begins = np.zeros(len(ids)), np.zeros(len(ids))
        for lo in range(0, len(ids), lm_scoring.SCORED):
            before = np.concatenate([np.full(lead + 1, encoder.end), ids])[lo : lo + lm_scoring.WINDOW]
            before = np.concatenate([before, np.full(lm_scoring.WINDOW - len(before), encoder.end)])
            g = model.forward(before[None])[0][0]
            for k, y in enumerate(ids[lo : lo + lm_scoring.SCORED]):
                p[lo + k], begins[lo + k] = np.log10(g[k] @ model.table[y]), np.log10(g[k] @ model.table[model.starts].sum(0))
        total, at = 0.0, 0
        for w, x in zip([*texts[i], b""], each, strict=True):
            own = p[at : at + len(x)].sum() - begins[at] + (begins[at + len(x)] if w else 0)
            total += np.log10((1 - lm_scoring.UNIGRAM_WEIGHT) * 10**own + lm_scoring.UNIGRAM_WEIGHT * count[w] / stats.tokens)
            at += len(x)
        assert abs(total - got[i]) < 1e-3 * abs(total) + 1e-3, i


def test_scores_do_not_depend_on_layout(spark, corpus, monkeypatch):
    monkeypatch.setattr(lm_scoring, "SAMPLE_ROWS", 10)
    monkeypatch.setattr(lm_scoring, "HEAD_WORDS", 50)
    d = spark.createDataFrame(list(corpus.items())[:90], "doc_id long, text string")
    one, other = ({r["doc_id"]: (r["score"], r["base_score"], r["n_known"]) for r in lm_scoring.score_documents(d.repartition(n), HELD).collect()} for n in (1, 5))
    assert all(one[i] == pytest.approx(other[i], rel=1e-4) for i in one) and len(one) == 90


def test_words_share_a_mass_of_one(corpus, scored):
    """After a text's beginning, all words and the end together have a probability of 1 at most; an early word takes no part of a longer one."""
    _, (head, stats, model) = scored
    words = lm_scoring.Words(head, lm_scoring.default_tokenizer())
    begin = lm_scoring.words_of(next(t for t in corpus.values() if t and len(t) > 500))[:7]
    pieces = [words.encoder.encoding.decode_bytes([i]).strip() for i in range(0, 50000, 9)]
    tried = list(dict.fromkeys([w for t in corpus.values() for w in lm_scoring.words_of(t)] + [w for w in (p.lower() for p in pieces) if w and len(w.split()) == 1]))
    texts = [[*begin, w] for w in tried] + [begin]
    tokens = np.array([len(t) + 1 for t in texts])
    score, _ = lm_scoring.word_scores(model, words, stats, words.slots(texts), tokens)
    mass = (10 ** score[np.cumsum(tokens) - 2][:-1]).sum() + 10 ** score[-1]
    rare = lm_scoring.UNIGRAM_WEIGHT * (1 - stats.counts.sum() / stats.tokens)
    assert 0.3 < mass < 1 - rare + 1e-6


def test_tables_learn_from_every_training_row(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "SAMPLE_ROWS", 1)
    monkeypatch.setattr(lm_scoring, "HEAD_WORDS", 2)
    kept = []
    real = lm_scoring.observe
    monkeypatch.setattr(lm_scoring, "observe", lambda *a: kept.append((a[0], a[1], *real(*a))) or kept[-1][2:])
    rows = [(i, f"the cat sat on the mat {i} " * 40 if i % 2 else "red green blue " * 40) for i in range(100)]
    out = lm_scoring.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id >= 80").collect()
    before, head, stats, model = kept[0]
    encoder = lm_scoring.Encoder.load(lm_scoring.default_tokenizer())
    ids = collections.Counter(i for k, t in rows if k < 80 for w in lm_scoring.words_of(t) for i in encoder.word(w))
    ids[encoder.end] = 80
    u = np.array([ids[i] for i in range(encoder.size)]) + 0.01
    assert np.allclose(model.shares, u / u.sum(), rtol=1e-6) and np.allclose(model.table.sum(0, dtype=float), 1, atol=1e-4)
    assert stats.tokens == 40 * 281 + 40 * 121 and stats.counts[0] == 80 and len(head) == 2
    assert not np.allclose(before.table, model.table, atol=0.01)
    assert all(-3 * r["n_tokens"] < r["score"] < 0 for r in out)


def test_attention_beats_the_base_on_held_out_texts(spark):
    sf = "/root/testdata/sf0.01"
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall())
    out = queries.QUERIES["op2_lm_scoring"](spark, sf).collect()
    seen = {texts[r["doc_id"]] for r in out if not r["held_out"]}
    new = [r for r in out if r["held_out"] and texts[r["doc_id"]] and texts[r["doc_id"]] not in seen]
    assert len(out) == 1000 and len(new) > 100 and sum(r["score"] for r in new) > sum(r["base_score"] for r in new)


def test_scores_on_awkward_rows(spark, awkward, nothing, monkeypatch):
    monkeypatch.setattr(lm_scoring, "SAMPLE_ROWS", 20)
    odd = lm_scoring.score_documents(awkward, "doc_id = 3").collect()
    assert len(odd) == 11 and {r["n_tokens"] for r in odd if r["doc_id"] in (1, 2, 6)} == {1}
    assert {r["held_out"] for r in odd if r["doc_id"] is None} == {False} and all(r["score"] < 0 and r["base_score"] < 0 for r in odd)
    assert lm_scoring.score_documents(nothing, "false").count() == 0
    alone = lm_scoring.score_documents(awkward, "true").collect()  # nothing to learn from
    assert {r["train_tokens"] for r in alone} == {0} and len(alone) == 11


# ---- pipeline and SQL ----------------------------------------------------------------------------------------------
def test_pipeline_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "pii", "mixing", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = corpus_pipeline.language_id(spark, docs, SF)
    assert first.columns == corpus_pipeline.COLUMNS and first.count() == docs.where("text rlike '\\\\p{L}'").count()
    kept = corpus_pipeline.near_dedup_stage(spark, docs, SF)
    want = brute_components({r["doc_id"]: r["text"] for r in docs.collect()}, 5, 80, 100)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, (_, c) in want.items() if c == i}
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_pipeline_keeps_one_row_of_each_group(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    near = a + " more"
    rows = [(5, a), (5, a), (None, a), (7, near), (9, near), (9, b), (9, b), (None, c), (None, c), (None, d), (1, ""), (2, ""), (2, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup_stage(spark, docs, SF).collect()), key=str)
    assert got == sorted([(5, a), (9, b), (None, c), (None, d), (1, ""), (2, "")], key=str)


def test_pipeline_stages_on_awkward_rows(spark, awkward, nothing):
    """Extra columns of any name, nulls and repeats: each stage gives the columns of documents and its own rows."""
    odd = awkward.select("*", *[F.lit("x").alias(c) for c in ("lang_pred", "n_private", "_h", "_i", "_quota", "component_id")])
    rows = [tuple(r) for r in awkward.select("doc_id", "text").collect()]
    lettered = [r for r in rows if r[1] and re.search("[a-zA-ZÀ-ÿ]", r[1])]
    got = corpus_pipeline.language_id(spark, odd, SF)
    assert got.columns == corpus_pipeline.COLUMNS and sorted(map(str, (tuple(r)[:2] for r in got.collect()))) == sorted(map(str, lettered))
    got = corpus_pipeline.pii_stage(spark, odd, SF)
    assert got.columns == corpus_pipeline.COLUMNS and sorted(map(str, (tuple(r)[:2] for r in got.collect()))) == sorted(map(str, rows))
    got = corpus_pipeline.mix_sources(spark, odd, SF)
    assert got.columns == corpus_pipeline.COLUMNS and {str(tuple(r)[:2]) for r in got.collect()} <= set(map(str, rows))
    assert corpus_pipeline.pack_tokens(spark, odd, SF).where("start = 0").count() == 11
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, SF).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for f in sorted(os.listdir(SF)):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in df.select(columns).collect())


def test_registered():
    names = list(__spark_entry__.queries())
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
