"""Operators 1, 3, 7 and 8 against brute force."""

import base64
import hashlib
import math
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from lumendex.llm import chat, common, contract, topk, url_filter, warc

# -- operator 1 ----------------------------------------------------------------------------


def by_hand(url):
    if url is None or "://" not in url:
        return "", "", None, None
    after = url.split("://", 1)[1]
    host = re.split(r"[/?#]", after, maxsplit=1)[0]
    path = re.split(r"[?#]", after[len(host) :], maxsplit=1)[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [r for r in contract.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.text), default=None)
    return host, path, best and best.text, best and best.verdict


URLS = ["http://A.Example.COM/en/1", "http://www.example.com/en/x?y", "http://m.www.example.com/en/", "https://example.com", "http://xcom/", "http://com/", "http://a.net/es/1#t", "http://a.net/en", "http://a.net/fr/",
        "no url", None, "", "://", "http://É.NET/es/", "http://h?q", "http://example.com?/en/", "a://b://c.com/", "http://a.org/" + "x" * 5000]


def test_rules_by_hand(spark):
    df = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").withColumns({"host": F.lit(1), "score": F.lit(1)})
    for r in url_filter.judge(df, contract.RULES).collect():
        host, path, rule, verdict = by_hand(URLS[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")
    assert url_filter.judge(df.limit(0), contract.RULES).collect() == []


def test_models_by_hand(spark):
    train = [("http://good.com/ab", "allow"), ("http://good.com/ab", "allow"), ("http://bad.net/es/é", "block")]
    counts = url_filter.count_grams(spark.createDataFrame(train, "url string, verdict string"))

    def log_likelihood(url, verdict):
        grams, contexts = {}, {}
        for u, v in train:
            b = b"\x02" * 4 + u.encode() + b"\x03"
            for i in range(4, len(b)):
                for n in range(1, 6):
                    if v == verdict:
                        grams[b[i - n + 1 : i + 1]] = grams.get(b[i - n + 1 : i + 1], 0) + 1
                        contexts[n, b[i - n + 1 : i]] = contexts.get((n, b[i - n + 1 : i]), 0) + 1
        b, total = b"\x02" * 4 + url.encode() + b"\x03", 0.0
        for i in range(4, len(b)):
            p = 1 / 256
            for n in range(1, 6):
                p = (grams.get(b[i - n + 1 : i + 1], 0) + url_filter.WEIGHT * p) / (contexts.get((n, b[i - n + 1 : i]), 0) + url_filter.WEIGHT)
            total += math.log(p)
        return total

    urls = ["http://good.com/abc", "http://bad.net/", "zz"]
    want = [(log_likelihood(u, "allow") - log_likelihood(u, "block")) / (len(u.encode()) + 1) for u in urls]
    assert np.allclose(url_filter.score([*urls, None, ""], counts), [*want, 0, 0])


def test_models_count_every_gram(spark):
    r = random.Random(5)
    train = [("".join(r.choices("abcdefghijklmnopqrstuvwxyz0123456789-._~/", k=60)), r.choice(["allow", "block"])) for _ in range(3000)]
    counts = url_filter.count_grams(spark.createDataFrame(train, "url string, verdict string"))
    tables = {}
    for u, v in train:
        b = b"\x02" * 4 + u.encode() + b"\x03"
        for i in range(4, len(b)):
            for n in range(1, 6):
                for what in (("gram", n, b[i - n + 1 : i + 1]), ("context", n, b[i - n + 1 : i])):
                    tables[v, *what] = tables.get((v, *what), 0) + 1
    assert len({k[3] for k in tables if k[1:3] == ("gram", 5)}) > 2**16

    def log_likelihood(url, v):
        b, total = b"\x02" * 4 + url.encode() + b"\x03", 0.0
        for i in range(4, len(b)):
            p = 1 / 256
            for n in range(1, 6):
                p = (tables.get((v, "gram", n, b[i - n + 1 : i + 1]), 0) + url_filter.WEIGHT * p) / (tables.get((v, "context", n, b[i - n + 1 : i]), 0) + url_filter.WEIGHT)
            total += math.log(p)
        return total

    urls = [u for u, _ in train[:50]] + ["zzz/~~~", "http://new.org/é"]
    want = [(log_likelihood(u, "allow") - log_likelihood(u, "block")) / (len(u.encode()) + 1) for u in urls]
    assert np.allclose(url_filter.score(urls, counts), want, rtol=1e-9, atol=1e-12)


def test_threshold():
    assert url_filter.best_threshold([(1, "allow", 3)]) == 0.0
    t = url_filter.best_threshold([(3000, "allow", 9), (2500, "block", 9)])
    assert 2500 < (t + url_filter.RANGE) / (2 * url_filter.RANGE) * url_filter.BINS <= 3000


def test_op1_whole_table(spark, sf_dir):
    rows = {r.page_id: r.url for r in common.table(spark, sf_dir, "pages").collect()}
    got = contract.op1_url_filters(spark, sf_dir).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.host, r.path, r.rule) == by_hand(rows[r.page_id])[:3]
    # The models find again what the rules hold apart.
    ruled = [(r.score, by_hand(rows[r.page_id])[3]) for r in got if r.rule]
    allowed, blocked = [s for s, v in ruled if v == "allow"], [s for s, v in ruled if v == "block"]
    assert np.mean(allowed) > np.mean(blocked)


# -- operator 3 ----------------------------------------------------------------------------


def test_topk_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "FAN_IN", 2)
    r = random.Random(2)
    rows = [(i, [float(r.randint(-3, 3)) / 256 for _ in range(3)]) for i in range(300)]
    rows += [(300, None), (301, [1.0, None, 2.0]), (302, [float("nan"), 1.0, 1.0]), (303, [float("inf"), 0.0, 0.0]), (350, [1e5, -1e5, 1.0]), (400, [1.0, 2.0]), (None, [1.0, 1.0, 1.0]), (5, rows[5][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(7)
    ok = df.where(F.col("vec_id").isNotNull() & topk.usable("embedding"))
    vectors = ok.select(F.col("vec_id").alias("id"), topk.quantised("embedding", 256).alias("v"))
    got = {}
    for x in topk.exact_topk(vectors.where("id % 50 = 0"), vectors, 5).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.vec_id, x.score))
    whole = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows if i is not None and v and None not in v and all(map(math.isfinite, v))]
    want = {}
    for i, v in whole:
        if i % 50 == 0:
            s = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in whole if j != i and len(w) == len(v))
            if s:
                want[i] = [(k + 1, j, -x) for k, (x, j) in enumerate(s[:5])]
    assert {k: sorted(v) for k, v in got.items()} == want


def test_large_products_are_exact():
    q = np.array([[2**30, 1]])
    v = np.array([[2**30, 1], [2**30, 2]])
    assert topk.tile(q, np.array([1]), v, np.array([2, 3]), 5)[2].tolist() == [2**60 + 2, 2**60 + 1]
    # Beyond 64 bits: exact as long as they fit, else the nearest that fits; a masked product doesn't matter.
    huge, least = np.array([[10**7] * 64, [2**62, 2**62] + [0] * 62]), np.array([[-(2**63)] + [0] * 63])
    assert topk.tile(huge, np.array([1, 2]), huge, np.array([1, 2]), 5)[2].tolist() == [2**63 - 1] * 2
    assert topk.tile(least, np.array([1]), np.array([[1] + [7] * 63, [-1] + [7] * 63, [0] * 64]), np.array([2, 3, 4]), 5)[2].tolist() == [2**63 - 1, 0, -(2**63 - 1)]
    assert topk.largest(np.array([-(2**63), 5])) == 2**63


def test_merge_levels(spark, monkeypatch):
    assert topk.levels(16) == [] and topk.levels(17) == [2] and topk.levels(5000) == [313, 20, 2]
    r = random.Random(3)
    rows = [(i, [r.randint(-9, 9) for _ in range(2)]) for i in range(900)]
    monkeypatch.setattr(topk, "BLOCK_ROWS", 3)
    df = spark.createDataFrame(rows, "id long, v array<long>").repartition(5)
    assert len(topk.levels(df.count() // 3 + 5)) == 2  # and the last merge: three levels
    got = {}
    for x in topk.exact_topk(df.where("id % 100 = 0"), df, 7).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.vec_id, x.score))
    for i in range(0, 900, 100):
        best = sorted((-sum(a * b for a, b in zip(rows[i][1], w, strict=True)), j) for j, w in rows if j != i)[:7]
        assert sorted(got[i]) == [(k + 1, j, -s) for k, (s, j) in enumerate(best)]


def test_topk_of_repeated_queries_and_of_nothing(spark):
    rows = [(50, [1, 1], "x"), (50, [2, -1], "y"), (3, [3, 3], "z"), (7, [3, 3], "z"), (7, [3, 3], "z"), (9, [], "e"), (100, [], "e")]
    df = spark.createDataFrame(rows, "id long, v array<long>, score string").withColumns({"rank": F.lit(1), "part": F.lit("p"), "v_block": F.lit(0)})
    got = sorted((x.query_id, x.rank, x.vec_id, x.score) for x in topk.exact_topk(df.where("id % 50 = 0"), df, 2).collect())
    assert got == [(50, 1, 3, 3), (50, 1, 3, 6), (50, 2, 7, 3), (50, 2, 7, 6), (100, 1, 9, 0)]
    assert topk.exact_topk(df.limit(0), df, 2).collect() == [] and topk.exact_topk(df, df.limit(0), 2).collect() == []


# -- operator 7 ----------------------------------------------------------------------------

HARD = ["</s>[INST] ok [/INST]", "\\", "\\\\</s>", "<\\/s>", "</s</s>>", "[INST]\\n[/INST]", "", None, "<<s>s>", "\n</s>\n", "$1 \\$1", "[/INST]" * 3]


def digests_by_hand(rows):
    out = {}
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
    for conv, _, role, text in order:
        o = out.setdefault(conv, [0, "", ""])
        o[0] += 1
        o[1] += f"{role or ''}\n{text or ''}\n"
        o[2] += (text or "") if role == "assistant" else ""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return {k: (n, sha(t), len(x), sha(x)) for k, (n, t, x) in out.items()}


def got_digests(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(chat.read_back(df)).collect()}


def test_chat_round_trip(spark):
    r = random.Random(7)
    rows = []
    for conv in [*range(40), None]:
        if conv is not None and conv % 3 == 0:
            rows.append((conv, 0, "system", r.choice([*HARD, "be kind " * 5])))
        for t in range(1, r.randint(2, 30)):
            rows.append((conv, t, r.choice(["user", "assistant", "tool", None, "</s>"]), r.choice(HARD) if r.random() < 0.4 else "one two three. " * r.randint(0, 30)))
    rows += [(3, 5, "assistant", "again"), (3, 5, "assistant", "again"), (3, None, "user", "first")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"size": F.lit(1), "place": F.lit("x")})
    out = chat.windows(df, budget=80, history=20)
    assert got_digests(out) == digests_by_hand(rows)
    size = {}
    for x in out.collect():
        assert x.formatted.count("</s>") == x.formatted.count("<s>[INST]")
        size.setdefault(x.conv_id, []).append((x.first, x.repeated, x.tokens))
    assert any(rep > 0 for w in size.values() for _, rep, _ in w)
    assert chat.windows(df.limit(0)).collect() == []


def test_long_conversations_in_parts(spark, monkeypatch):
    monkeypatch.setattr(chat, "PART_TURNS", 10)
    rows = [(1, t * 7 - 50, ("user", "assistant")[t % 2], f"turn {t} " * (t % 5)) for t in range(95)] + [(1, None, "system", "rule"), (2, 1, "user", "hi"), (None, 3, "assistant", "x")]
    rows += [(1, -(2**63), "user", "least"), (1, 2**63 - 1, "assistant", "most")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.windows(df, budget=60, history=20)
    assert got_digests(out) == digests_by_hand(rows)
    even = chat.windows(df.where("turn is null or turn between -1000 and 1000"), budget=60, history=20)
    assert all(x.formatted.startswith("<s>[INST]system[/INST]rule") and x.tokens <= 60 for x in even.where("conv_id = 1").collect())
    assert even.select((F.col("first") / F.lit(1 << 32)).cast("int")).distinct().count() > 5


def test_parts_give_the_windows_of_the_whole(spark, monkeypatch):
    r = random.Random(9)
    rows = [(c, t * t if c == 3 else t, r.choice(["user", "assistant"]), f"turn {t} " * r.choice([0, 1, 2, 3, 40])) for c in (1, 2, 3, None) for t in range(1, 120)]
    rows += [(1, None, "system", "rule"), (2, 0, "system", "rule " * 90), (3, 2**62, "user", "far"), (4, 1, "user", "hi"), (4, 2, "assistant", "ho")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")

    def told():
        out = [(repr(x.conv_id), x.first % (1 << 32) if x.conv_id == 4 else 0, x.formatted, x.repeated, x.loss, x.tokens) for x in chat.windows(df, budget=60, history=20).collect()]
        digests = chat.digests(chat.read_back(chat.windows(df, budget=60, history=20))).collect()
        return sorted(out), sorted(map(tuple, digests), key=repr)

    whole = told()
    for size in (40, 7, 1):
        monkeypatch.setattr(chat, "PART_TURNS", size)
        assert told() == whole


def test_long_conversations_at_the_default_size(spark, monkeypatch):
    # As many turns as make two parts and more; equal, missing and outlying numbers of turns; the same turn over and over.
    rows = [(1, t, ("user", "assistant")[t % 2], f"turn {t} " * (t % 4)) for t in range(4097)]
    rows += [(2, 5, ("user", "assistant")[t % 2], f"said {t}") for t in range(10_000)]
    rows += [(3, None, "assistant", f"{t} times") for t in range(5000)] + [(3, 2**62, "user", "far")]
    rows += [(4, 1, "assistant", "the same")] * 9000 + [(4, 0, "system", "rule"), (None, 1, "user", "hi")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")

    def told():
        return sorted((repr(x.conv_id), x.formatted, x.repeated, x.loss, x.tokens) for x in chat.windows(df).collect())

    parted = told()
    longest = chat.windows(df).groupBy((F.col("first") / F.lit(1 << 32)).cast("int")).count().count()
    assert longest >= 5
    monkeypatch.setattr(chat, "PART_TURNS", 1 << 40)
    assert told() == parted


def test_windows_keep_the_budget(spark):
    rows = [(1, 0, "system", "rule " * 5)] + [(1, t, ("user", "assistant")[t % 2], "w " * (t % 7 + 1)) for t in range(1, 200)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.windows(df, budget=60, history=20).orderBy("first").collect()
    assert len(got) > 5 and all(x.tokens <= 60 for x in got)
    assert all(x.formatted.startswith("<s>[INST]system[/INST]rule") for x in got)
    # Repeated assistant turns are shown but carry no loss.
    for x in got:
        for s in x.loss:
            assert x.formatted[: s.start].count("</s>") >= x.repeated


def test_op7_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in contract.op7_chat_formatting(spark, sf_dir).collect()}
    assert got == digests_by_hand(rows)


# -- operator 8 ----------------------------------------------------------------------------


def archive(n, packed=True):
    out = []
    for i in range(n):
        p = f"<p>{i}</p>".encode() * (i + 1)
        rec = warc.record(i, f"http://x/{i}", p, len(p), hashlib.sha1(p).hexdigest(), None)
        out.append(warc.compress(rec) if packed else rec)
    return out


def test_salvage_after_damage():
    for packed in (True, False):
        parts = archive(6, packed)
        whole = b"".join(parts)
        assert [f.offset for f in warc.salvage(whole)] == [sum(map(len, parts[:i])) for i in range(6)]
        bad = bytearray(parts[2])
        bad[-12] ^= 0xFF  # in the block, or near the checksum
        broken = b"junk" + parts[0] + parts[1] + bytes(bad) + parts[3] + b"\0\0WARC/1.1\r\nnope" + parts[4] + parts[5][:-7]
        found = list(warc.salvage(broken))
        ids = [f.headers["warc-record-id"].rsplit(":", 1)[1].rstrip(">") for f in found if f.reason is None]
        gaps = [(f.offset, f.length) for f in found if f.reason]
        assert ids == ["0", "1", "3", "4"]
        at = 4 + len(parts[0]) + len(parts[1])
        assert gaps[:2] == [(0, 4), (at, len(bad))]
        assert sum(f.length for f in found) == len(broken) and found[-1].reason
    assert list(warc.salvage(b"")) == []


def test_large_record_is_one_member_and_an_empty_one(monkeypatch):
    monkeypatch.setattr(warc, "MEMBER_BYTES", 1000)
    p = bytes(range(256)) * 20
    record = warc.record(1, None, p, len(p), hashlib.sha1(p).hexdigest(), None)
    one = warc.compress(record)
    two = archive(2)
    first = zlib.decompressobj(31)
    assert first.decompress(one) == record and first.eof and first.unused_data == warc.EMPTY and one.endswith(b"\0") and zlib.decompress(warc.EMPTY, 31) == b""
    found = list(warc.salvage(two[0] + one + two[1]))
    assert [f.reason for f in found] == [None] * 3 and found[1].block.endswith(p) and found[1].length == len(one)
    assert [f.reason for f in warc.salvage(warc.EMPTY + two[0] + one[:-3])] == [None, None, "truncated member"]


def several(data):
    """Members of 1000 bytes each, as other writers may cut a record."""
    return b"".join(warc.compress(data[k : k + 1000]) for k in range(0, len(data), 1000))


def test_large_record_in_several_members():
    p = bytes(range(256)) * 20
    one, two = several(warc.record(1, None, p, len(p), hashlib.sha1(p).hexdigest(), None)), archive(2)
    assert one.count(b"\x1f\x8b\x08") >= 5
    found = list(warc.salvage(two[0] + one + two[1]))
    assert [f.reason for f in found] == [None] * 3 and found[1].block.endswith(p)


def test_members_of_many_records():
    def told(content):
        found = list(warc.salvage(content))
        assert sum(f.length for f in found) == len(content)
        return [f.reason and "gap" or int(f.headers["warc-record-id"].rsplit(":", 1)[1].rstrip(">")) for f in found]

    plain = archive(9, packed=False)
    bad = plain[4].replace(b"<p>4", b"<q>4", 1)
    assert told(warc.compress(b"".join(plain))) == list(range(9))
    assert told(warc.compress(b"".join(plain[:3])) + warc.compress(plain[3]) + warc.compress(b"".join(plain[4:]))) == list(range(9))
    assert told(warc.compress(b"".join([*plain[:4], bad, *plain[5:]]))) == [0, 1, 2, 3, "gap", 5, 6, 7, 8]
    assert told(warc.compress(b"tail of another" + b"".join(plain[:2]) + plain[2][:-9]) + warc.compress(plain[3])) == ["gap", 0, 1, "gap", 3]
    # Records lie across the borders of members; a damaged member takes only the records that it has part of.
    data = b"".join(plain)
    whole = b"".join(warc.compress(data[k : k + 700]) for k in range(0, len(data), 700))
    assert told(whole) == list(range(9))
    second = whole.index(b"\x1f\x8b\x08", whole.index(b"\x1f\x8b\x08", 1) + 1)
    damaged = bytearray(whole)
    damaged[second + 40] ^= 0xFF
    got = told(bytes(damaged))
    assert got.count("gap") >= 1 and {0, 1, 6, 7, 8} <= set(got)


def foreign(digest, payload=b"<p>x</p>", kind="response", identity="<urn:uuid:1b2c>", more=()):
    block = b"HTTP/1.1 200 OK\r\n\r\n" + payload
    lines = ["WARC/1.0", *([f"WARC-Type: {kind}"] if kind else []), f"WARC-Record-ID: {identity}", *([f"WARC-Block-Digest: {digest(block)}"] if digest else []), *more, f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_archives_of_others(spark):
    sha1 = lambda b: hashlib.sha1(b)
    digests = {
        "base32": lambda b: "sha1:" + base64.b32encode(sha1(b).digest()).decode(),
        "lower base32": lambda b: "SHA1:" + base64.b32encode(sha1(b).digest()).decode().lower(),
        "upper hex": lambda b: "sha1:" + sha1(b).hexdigest().upper(),
        "sha256": lambda b: "sha-256:" + hashlib.sha256(b).hexdigest(),
        "md5 base32": lambda b: "md5:" + base64.b32encode(hashlib.md5(b).digest()).decode().rstrip("="),
        "unknown": lambda b: "blake9:00ff",
        "unreadable": lambda b: "sha1:!",
        "none": None,
    }
    for name, digest in digests.items():
        assert [f.reason for f in warc.salvage(foreign(digest))] == [None], name
    for name in ("base32", "upper hex", "sha256", "md5 base32"):
        good = foreign(digests[name])
        assert [f.reason for f in warc.salvage(good.replace(b"<p>x", b"<p>y"))] == ["block digest differs"], name
    records = [
        foreign(None, kind=None),
        foreign(None, identity="<urn:lumendex:page:99999999999999999999>"),
        foreign(None, kind="revisit", more=["WARC-Payload-Digest: sha1:" + base64.b32encode(sha1(b"z").digest()).decode()]),
        foreign(None, kind="warcinfo"),
    ]
    path = common.fresh_path(spark, "w")
    common.write_bytes(spark.createDataFrame([(b"".join(records) + b"\n",)], "record binary"), "record", path, "\n")
    got = warc.read(spark, path).orderBy("offset").collect()
    assert [(r.page_id, r.record_type, r.gap_reason) for r in got] == [(None, "unknown", None), (None, "response", None), (None, "revisit", None), (None, "warcinfo", None), (None, None, "no version line")]
    assert got[0].payload_digest == sha1(b"<p>x</p>").hexdigest() and got[2].payload_digest == sha1(b"z").hexdigest() and got[2].payload_bytes is None


def test_headers_of_any_length(spark, monkeypatch):
    urls = ["http://a/" + "x" * 70_000, "http://b/" + "\n" * 400_000, "http://c/" + "y" * (1 << 20)]
    records = [warc.record(i, u, b"p", 1, hashlib.sha1(b"p").hexdigest(), None) for i, u in enumerate(urls)]
    plain = list(warc.salvage(b"junk" + b"".join(records)))
    assert [f.reason is None for f in plain] == [False, True, True, True]
    assert [f.headers["warc-target-uri"] for f in plain[1:]] == [urls[0], "http://b/" + "%0A" * 400_000, urls[2]]
    monkeypatch.setattr(warc, "MEMBER_BYTES", 300_000)
    assert [f.headers["warc-target-uri"] for f in warc.salvage(b"".join(map(warc.compress, records)))] == [f.headers["warc-target-uri"] for f in plain[1:]]
    monkeypatch.undo()
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("html", F.lit("p"))
    path = common.fresh_path(spark, "w")
    warc.write(df, path)
    assert sorted((r.page_id, r.gap_reason, len(r.url)) for r in warc.read(spark, path).collect()) == [(0, None, 70_009), (1, None, 1_200_009), (2, None, (1 << 20) + 9)]


def pages_by_hand(rows):
    most = {}
    for i, _, html in rows:
        p = (html or "").encode()
        if len(p) >= 1000 and i is not None:
            most[p] = max(i, most.get(p, i))
    out = []
    for i, _, html in rows:
        p = (html or "").encode()
        r = most.get(p)
        revisit = r is not None and i != r
        out.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if revisit else "response", r if revisit else None))
    return sorted(out, key=str)


def test_warc_jobs(spark):
    long_, other = "é" * 500, "y" * 1000
    rows = [(1, "http://a", long_), (2, None, long_), (3, "b\r\nc", other), (4, "u", None), (5, "u", ""), (6, "u", "y" * 999), (7, "u", "y" * 999), (8, "u", long_), (8, "u", long_), (None, "u", long_), (None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"k": F.lit(1), "n": F.lit(2), "kept": F.lit(3)})
    path = common.fresh_path(spark, "w")
    warc.write(df, path)
    got = warc.read(spark, path).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == pages_by_hand(rows)
    assert all(r.gap_reason is None for r in got)
    empty = common.fresh_path(spark, "w")
    warc.write(df.limit(0), empty)
    assert warc.read(spark, empty).collect() == []


def test_op8_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in common.table(spark, sf_dir, "pages").select("page_id", "url", "html").collect()]
    got = contract.op8_warc(spark, sf_dir).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == pages_by_hand(rows)
