"""Each operator against a brute-force version, an exact round trip or held-out accuracy, and on odd input."""

from __future__ import annotations

import base64
import binascii
import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

SECRET = "token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\""


def by_id(df, key="doc_id"):
    return {r[key]: r.asDict() for r in df.collect()}


def clashing(df):
    """The same with extra columns whose names clash."""
    return df.selectExpr("'z' AS TEXT", "*", "1 AS `a.b`", "2 AS Doc_Id") if "text" in df.columns else df


# --- 1: sharding

def test_min_cost_flow_moves_least():
    from docloom.llm.sharding import min_cost_flow

    r = random.Random(1)
    for _ in range(40):
        n = r.randrange(1, 4)
        supply = [r.randrange(0, 6) for _ in range(n)]
        capacity = [r.randrange(0, 6) for _ in range(n)]
        if sum(supply) > sum(capacity):
            with pytest.raises(ValueError):
                min_cost_flow(supply, capacity)
            continue
        flow = min_cost_flow(supply, capacity)
        assert [sum(f) for f in flow] == supply
        assert all(sum(f[j] for f in flow) <= capacity[j] for j in range(n))
        # what can stay, stays: no solution moves less
        assert sum(flow[i][j] for i in range(n) for j in range(n) if i != j) == sum(supply) - sum(min(s, c) for s, c in zip(supply, capacity))


def test_sharding(documents, odd_texts, prose):
    from docloom.llm.sharding import shard_documents

    texts = odd_texts + [prose(random.Random(k).randrange(1, 120)) for k in range(400)]
    docs = documents(texts)
    out = shard_documents(clashing(docs))
    got = by_id(out)
    assert len(got) == len(texts)
    total = defaultdict(int)
    slots = defaultdict(list)
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        assert got[i]["size"] == len(raw) + 1 and got[i]["text_crc32"] == binascii.crc32(raw)
        total[got[i]["shard"]] += got[i]["size"]
        slots[got[i]["shard"]].append(got[i]["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(total) <= set(range(8))


def test_shard_sizes_are_nearly_equal(documents, prose):
    from docloom.llm.sharding import shard_documents

    sizes = defaultdict(int)
    for r in shard_documents(documents([prose(random.Random(k).randrange(1, 200)) for k in range(500)])).collect():
        sizes[r["shard"]] += r["size"]
    assert max(sizes.values()) - min(sizes.values()) <= 0.01 * sum(sizes.values()) / 8


def test_sharding_of_nothing_and_of_repeated_rows(documents):
    from docloom.llm.sharding import shard_documents

    assert shard_documents(documents([])).count() == 0
    out = shard_documents(documents(["a", "a", None, "b"], [1, 1, None, None])).collect()
    assert len(out) == 4 and {r["grown_shard"] for r in out} == {None}


def test_only_affected_shards_are_rewritten(spark, documents, tmp_path):
    from pyspark.sql import functions as F

    from docloom.llm.sharding import reshard_files, size_of

    docs = documents([c * 100 for c in "abcdefgh" for _ in range(20)])
    old = str(tmp_path / "old")
    docs.withColumn("shard", F.when(F.col("doc_id") < 40, 0).when(F.col("doc_id") < 80, 1).otherwise(2)).write.partitionBy("shard").parquet(old)
    each = docs.agg(F.sum(size_of())).first()[0] // 4
    files = reshard_files(spark, old, str(tmp_path / "new"), [each, each, each, each]).collect()
    assert all(f"{tmp_path}/old" in r["file"] for r in files if r["shard"] < 2)
    assert 3 in {r["shard"] for r in files if f"{tmp_path}/new" in r["file"]} <= {2, 3}
    sizes = {s: spark.read.parquet(*(r["file"] for r in files if r["shard"] == s)).count() for s in range(4)}
    assert sizes == {0: 40, 1: 40, 2: 40, 3: 40}


def test_sharding_of_one_doc_id_on_half_the_rows(documents, prose):
    from docloom.llm.sharding import shard_documents

    ids = [1 if k % 2 else None if k % 4 else k for k in range(600)]
    out = shard_documents(documents([prose(20) for _ in ids], ids)).collect()
    sizes = defaultdict(int)
    for r in out:
        sizes[r["shard"]] += r["size"]
    assert len(out) == 600 and max(sizes.values()) - min(sizes.values()) <= 0.02 * sum(sizes.values()) / 8


def test_sharding_leaves_even_files_alone(spark, documents, prose, tmp_path):
    """Files whose shards have the right sizes stay where they are, and their rows have gapless slots; filtered rows are written first."""
    from pyspark.sql import functions as F

    from docloom.llm.sharding import Resharding, shard_documents

    path = str(tmp_path / "many")
    documents([f"text number {100 + k}" for k in range(320)]).repartition(16).write.parquet(path)
    plan = Resharding(spark.read.parquet(path), 8)
    placed = plan.placed(str(tmp_path / "new")).collect()
    assert sorted(r["doc_id"] for r in placed) == list(range(320)) and {"text", "lang", "source", "n_chars"} <= set(placed[0].asDict())
    slots = defaultdict(list)
    for r in placed:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(40)) for s in slots.values()) and len(slots) == 8
    held = defaultdict(int)
    for r in placed:
        held[r["old_shard"]] += 16
    assert plan.moved_bytes <= sum(max(0, v - 16 * 40) for v in held.values()) + 16 * 8
    some = shard_documents(spark.read.parquet(path).where(F.col("doc_id") % 3 == 0)).collect()
    assert len(some) == 107 and all(max(r["slot"] for r in some if r["shard"] == s) < 15 for s in range(8))


# --- 2: top-k

@pytest.mark.parametrize("scale", [1.0, 1e6])
def test_top_k(spark, scale):
    import math

    from docloom.llm.topk import top_k

    r = random.Random(2)
    rows = [(i, [r.choice([r.gauss(0, 0.2) * scale, 0.25]) for _ in range(r.choice([16, 16, 16, 3]))]) for i in range(260)]
    rows += [(300, None), (350, [1.0, None]), (400, [float("nan")] * 16), (450, [float("inf")] * 16), (500, []), (501, []), (None, [0.5] * 16), (7, rows[7][1])]
    got = top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    valid = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    expected = set()
    for i, q in valid:
        if i % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in valid if j != i and len(v) == len(q))
            expected |= {(i, k + 1, j, -s) for k, (s, j) in enumerate(scores[:5])}
    assert {tuple(r) for r in got} == expected


def test_top_k_of_nothing(spark):
    from docloom.llm.topk import top_k

    assert top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert top_k(spark.createDataFrame([(50, [1.0])], "vec_id long, embedding array<float>")).count() == 0


# --- 3: urls

def test_rules_and_propagation(spark):
    from docloom.llm.urls import judge

    link = '<a class="x" href="{}">y</a>'
    rows = [
        (1, "https://A.example.COM/en/7/x?y#z", None), (2, "http://b.com/en/1", None), (3, "ftp://x.net/de/", "<p>"), (4, "no scheme", None), (5, None, None), (6, "x://example.com", None),
        (7, "http://shop.example.com/en/70", link.format("https://partner.example/a") * 2), (8, "http://partner.example/b", link.format("//friend.example")), (9, "http://friend.example/", ""),
        (10, "http://spammer.test/", link.format("http://casino-win.test/x")), (11, "http://booster.test/", link.format("http://spammer.test")), (12, "http://casino-win.test/", None),
        (13, "http://notexample.com/fr/", None), (14, "a://b://c/d", None), (15, "http://xorg/es/", None), (16, "http://x.org/es", None), (8, "http://partner.example/b", link.format("//friend.example")),
    ]
    out = judge(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'q' AS URL"))
    assert out.count() == len(rows)
    got = by_id(out, "page_id")
    view = lambda i: tuple(got[i][k] for k in ("host", "path", "rule", "verdict"))
    assert view(1) == ("a.example.com", "/en/7/x", "example.com/en/7", "allow")
    assert view(2) == ("b.com", "/en/1", "com/en/", "block")
    assert view(3) == ("x.net", "/de/", "net/de/", "block")
    assert view(4) == view(5) == ("", "", None, "allow")
    assert view(6) == ("example.com", "", None, "allow")
    assert view(14) == ("b:", "//c/d", None, "allow")
    assert view(15)[2] is None and view(16)[2] is None
    # trust flows along links, distrust against them
    assert view(8)[3] == view(9)[3] == "allow"
    assert view(10)[3] == view(11)[3] == view(12)[3] == "block"
    assert judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_distrust_goes_the_whole_way(spark):
    from docloom.llm.urls import judge

    hosts = [f"h{i}.test" for i in range(17)] + ["spam-farm.test"]
    rows = [(i, f"http://{h}/", f'<a href="http://{n}/">x</a>') for i, (h, n) in enumerate(zip(hosts, hosts[1:]))]
    got = by_id(judge(spark.createDataFrame(rows, "page_id long, url string, html string")), "page_id")
    assert {r["verdict"] for r in got.values()} == {"block"}


def test_propagation_against_matrices(spark):
    """Trust and distrust on a random graph, with a chain of 30 hosts, against solving the linear systems."""
    import numpy as np

    from docloom.llm.urls import DAMPING, propagate

    r = random.Random(17)
    n = 45
    weights = {(i, i + 1): 1 for i in range(30)} | {(r.randrange(n), r.randrange(n)): r.randrange(1, 5) for _ in range(60)}
    weights = {e: w for e, w in weights.items() if e[0] != e[1]}
    edges = spark.createDataFrame([(f"h{a}", f"h{b}", w) for (a, b), w in weights.items()], "src string, dst string, weight long")
    trust, distrust = np.zeros(n), np.zeros(n)
    trust[[0, 33]], distrust[[29, 40, 41]] = 1 / 2, 1 / 3
    seeds = spark.createDataFrame([(f"h{i}", float(trust[i]), float(distrust[i])) for i in range(n) if trust[i] or distrust[i]], "host string, trust double, distrust double")
    a = np.zeros((n, n))
    for (x, y), w in weights.items():
        a[x, y] = w
    share = lambda m: np.divide(m, m.sum(axis=1, keepdims=True), out=np.zeros_like(m), where=m.sum(axis=1, keepdims=True) > 0)
    solved = [np.linalg.solve(np.eye(n) - DAMPING * share(m).T, (1 - DAMPING) * s) for m, s in ((a, trust), (a.T.copy(), distrust))]
    got = {x["host"]: x for x in propagate(edges, seeds).collect()}
    for i in range(n):
        for name, exact in zip(("trust", "distrust"), solved, strict=True):
            assert (got[f"h{i}"][name] if f"h{i}" in got else 0.0) == pytest.approx(exact[i], rel=1e-4, abs=1e-12)


def test_distrust_reaches_those_who_link_to_bad_hosts(spark):
    """Of the same pages' graph: hosts that link to a blocked seed go, hosts that a trusted one links to stay, others are allowed."""
    from docloom.llm.urls import judge

    link = lambda *hosts: "".join(f'<a class="x" href="https://{h}/p">x</a>' for h in hosts)
    pages = [("a.spam-farm.io", ""), ("friend.io", link("a.spam-farm.io")), ("friend2.io", link("friend.io")), ("example.com", link("good.io", "good.io")), ("good.io", link("a.spam-farm.io", "fine.io")), ("alone.io", "<p>" * 50_000), ("fine.io", "")]
    rows = [(i, f"http://{h}/" + ("en/7" if h == "example.com" else ""), x) for i, (h, x) in enumerate(pages)]
    got = {r["host"]: r["verdict"] for r in judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[h] for h, _ in pages] == ["block", "block", "block", "allow", "allow", "allow", "allow"]


# --- 4: Jaccard join

def components_by_force(texts, k, limit):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        if sets[a] and sets[b] and limit[1] * len(sets[a] & sets[b]) >= limit[0] * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize(("k", "limit"), [(4, (85, 100)), (5, (80, 100))])
def test_jaccard_components(documents, odd_texts, prose, k, limit):
    from docloom.llm.jaccard import cluster

    r = random.Random(k)
    texts = list(odd_texts)
    for n in (3, 4, 6, 8, 9, 12, 15, 20, 30, 60, 200):
        base = prose(n)
        for _ in range(6):
            w = base.split()
            for _ in range(r.randrange(0, 3)):
                w[r.randrange(len(w))] = "changed" + str(r.randrange(3))
            texts.append(" ".join(w))
            base = texts[-1] if r.random() < 0.5 else base
        texts += [base.upper(), base]
    shared = prose(50)
    texts += [f"{shared} {prose(20)}" for _ in range(12)]
    expected = components_by_force(texts, k, limit)
    got = by_id(cluster(clashing(documents(texts)), k, limit))
    assert [(got[i]["n_shingles"], got[i]["component_id"]) for i in range(len(texts))] == expected


def test_jaccard_gives_all_links(documents, odd_texts, prose):
    from docloom.llm.jaccard import cluster, links

    r = random.Random(21)
    base, texts = prose(80).split(), list(odd_texts)
    for k in range(25):  # one component with many links
        texts.append(" ".join([*base, *(f"end{x}" for x in range(r.randrange(0, 6)))]))
    texts += ["p q r s t", "P q r s t", "p q r s t u"]
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[a : a + 4]) for a in range(len(w) - 3)) if len(w) >= 4 else frozenset({tuple(w)} if w else ()))
    fits = lambda a, b: bool(a and b) and 100 * len(a & b) >= 85 * len(a | b)
    got = by_id(cluster(documents(texts)))
    assert [got[i]["n_links"] for i in range(len(texts))] == [sum(fits(x, y) for j, y in enumerate(sets) if j != i) for i, x in enumerate(sets)]
    assert [got[i]["component_id"] for i in range(len(texts))] == [c for _, c in components_by_force(texts, 4, (85, 100))]
    table, found = links(documents(texts))
    of = {bytes(r["set"]): sets[r["doc_id"]] for r in table.where("set is not null").collect()}
    pairs = {frozenset((of[bytes(r["a"])], of[bytes(r["b"])])) for r in found.collect()}
    assert pairs == {frozenset((x, y)) for x, y in itertools.combinations(set(sets), 2) if fits(x, y)} and len(pairs) > 5


def test_jaccard_nulls_and_nothing(documents):
    from docloom.llm.jaccard import cluster, keep_one

    assert cluster(documents([])).count() == 0
    docs = documents(["a b c d e f", "a b c d e f", "a b c d e f", None, ""], [None, 5, 3, 2, 1])
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in cluster(docs).collect()) == [(-1, -1), (1, 1), (2, 2), (3, 3), (5, 3)]
    assert sorted(r["doc_id"] or -1 for r in keep_one(docs).collect()) == [-1, 1, 2, 3]


def test_keep_one_tells_texts_of_one_id_apart(documents):
    from docloom.llm.jaccard import keep_one

    copy, near = "a b c d e f g h i j k l", "a b c d e f g h i j k l m"
    docs = documents([copy, copy, "another text that stands alone here", "p " + near, near, "", ""], [1, 2, 2, 3, 3, 4, 4])
    got = sorted((r["doc_id"], r["text"]) for r in keep_one(docs, 5, (80, 100)).collect())
    assert got == [(1, copy), (2, "another text that stands alone here"), (4, ""), (4, "")]
    alone = documents([near, "p " + near], [3, 3])
    assert keep_one(alone, 5, (80, 100)).count() == 1


def test_every_linking_light_pair_shares_a_key():
    import numpy as np

    from docloom.llm.jaccard import least_overlap, light_keys, subset_keys

    r = random.Random(9)
    limit = (85, 100)
    for _ in range(300):
        n = r.randrange(1, 20)
        a = set(r.sample(range(1, 10**6), n))
        b = set(a)
        for _ in range(r.randrange(0, 4)):
            b.discard(r.choice(sorted(a)))
            b |= {r.randrange(10**6, 10**7)} if r.random() < 0.6 else set()
        keys = [set(light_keys(np.array(sorted(x), np.uint64), 40, limit)) for x in (a, b) if x]
        if b and 100 * len(a & b) >= 85 * len(a | b):
            assert len(a & b) >= least_overlap(len(a), len(b), limit) and keys[0] & keys[1]
        assert len(keys[0]) <= subset_keys(n, limit)


# --- 5: secrets

def test_secret_spans(documents, odd_texts):
    from docloom.llm.secrets import scan

    assign_pattern = re.compile(r"(?i)(password|passwd|secret|token|api_?key)[\"']?[ ]*[:=][ ]*[\"']?([a-z0-9+/_.=-]+)", re.A)

    texts = odd_texts + [
        f"é {SECRET} and AKIA{'A1' * 9}, x", "PassWord: hunter2hunter2 passwd=short token: password = abcdefghijklmnop", "0123456789abcdef0123 " * 2, "api_key='Zz9+/_.=-Zz9' APIKEY : abcdefghijkl",
        "the password is 7Qw8zKp2LmN4xYv6TbR1cJd3x now", "call 5551234567 on 2020-01-02, version 1.2.3-rc4", "ſecret: abcdefghijklmnop",
    ]
    got = by_id(scan(clashing(documents(texts))))
    for i, t in enumerate(texts):
        t = t or ""
        assign = [m.span() for m in assign_pattern.finditer(t) if len(m[2]) >= 12]
        access = [m.span() for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        hexes = [m.span() for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 16]
        base = sorted([(a, 0, b, "assign") for a, b in assign] + [(a, 1, b, "access") for a, b in access] + [(a, 2, b, "hex") for a, b in hexes])
        spans = ",".join(f"{k}:{a}:{b}" for a, _, b, k in base)
        assert (got[i]["n_assign"], got[i]["n_access"], got[i]["n_hex"]) == (len(assign), len(access), len(hexes))
        assert got[i]["base_sha256"] == hashlib.sha256(spans.encode()).hexdigest()
        assert set(filter(None, spans.split(","))) <= set(got[i]["spans"].split(","))
    spoken = got[len(odd_texts) + 4]["spans"]
    assert spoken.startswith("crf:") and texts[len(odd_texts) + 4][slice(*map(int, spoken.split(":")[1:]))] == "7Qw8zKp2LmN4xYv6TbR1cJd3x"
    assert got[len(odd_texts) + 5]["spans"] == "" and got[len(odd_texts) + 6]["n_assign"] == 0
    assert scan(documents([])).count() == 0


def test_secrets_without_digits_short_and_with_symbols(documents):
    from docloom.llm.secrets import redact

    found = ["CorrectHorseBatteryStaple", "hunter2", "P@ssw0rd!x#Zq", "QwHzTrKpLmNvYbXcRdJs"]
    plain = ["the password is required for all users", "the secret of the old house", "a key point of the talk", "access to the private garden"]
    texts = [f"we know the password is {x} for now" for x in found] + plain
    rows = by_id(redact(documents(texts)))
    assert [x in rows[i]["text"] for i, x in enumerate(found)] == [False] * len(found)
    assert [rows[len(found) + i]["text"] for i in range(len(plain))] == plain


def test_viterbi_is_exact(monkeypatch):
    """Against all tags of short chains; and, in pieces of five tokens, against the plain recursion on long ones."""
    import numpy as np

    from docloom.llm import secrets

    r = np.random.default_rng(4)

    def value(tags, e, move):
        chain = [0, *tags, 0]
        return sum(move[a, b] for a, b in zip(chain, chain[1:])) + sum(e[t, k] for t, k in enumerate(tags))

    for _ in range(40):
        e, move = r.normal(size=(r.integers(1, 6), 3)), r.normal(size=(3, 3))
        assert np.isclose(value(secrets.viterbi(e, move), e, move), max(value(t, e, move) for t in itertools.product(range(3), repeat=len(e))))
    monkeypatch.setattr(secrets, "PIECE", 5)
    for n in (4, 5, 6, 23, 60):
        e, move = r.normal(size=(n, 3)), r.normal(size=(3, 3))
        best = move[0] + e[0]
        for t in range(1, n):
            best = (best[:, None] + move).max(axis=0) + e[t]
        assert np.isclose(value(secrets.viterbi(e, move), e, move), (best + move[:, 0]).max())


def test_marginals_against_all_tags():
    import numpy as np

    from docloom.llm.secrets import marginals

    r = np.random.default_rng(5)
    lengths = [1, 3, 4, 2]
    e, move = r.normal(size=(4, 4, 3)), r.normal(size=(3, 3))
    real = np.arange(4) < np.array(lengths)[:, None]
    p, moves, total = marginals(e, move, real)
    for c, n in enumerate(lengths):
        tag, step, every = np.zeros((4, 3)), np.zeros((3, 3)), 0.0
        for tags in itertools.product(range(3), repeat=n):
            chain = [0, *tags, 0]
            w = np.exp(sum(move[a, b] for a, b in zip(chain, chain[1:])) + sum(e[c, t, k] for t, k in enumerate(tags)))
            every += w
            for t, k in enumerate(tags):
                tag[t, k] += w
            for a, b in zip(chain, chain[1:]):
                step[a, b] += w
        step[0, 0] -= 0  # moves from and to the tokens around count, too
        assert np.isclose(total[c], np.log(every)) and np.allclose(p[c], tag / every) and np.allclose(moves[c], step / every)


def test_texts_that_are_left_out_have_no_secret_for_certain(prose):
    """The bound that lets texts go without decoding: the same spans as decoding each text on its own."""
    import numpy as np
    import pyarrow as pa

    from docloom.llm import secrets
    from docloom.llm._shared import utf8

    r = np.random.default_rng(6)
    texts = [prose(n) for n in (5, 0, 40, 3)] + ["password: zz9 yy8 xx7", "a b c", "key = Abc123"] * 5
    for scale in (0.1, 0.5):
        field = secrets.Field(r.normal(size=(secrets.VALUES, 2)) * scale - 0.05, r.normal(size=(3, 3)))
        field.move[0, 2] = secrets.FORBIDDEN
        found = field.spans(*utf8(pa.array(texts)))
        for k, text in enumerate(texts):
            tokens = secrets.Tokens(*utf8(pa.array([text])))
            tags = secrets.viterbi(field.scores(tokens.features), field.move) if len(tokens.start) else []
            spans = []
            for t, tag in enumerate(tags):
                if tag == secrets.BEGIN:
                    spans.append((int(tokens.start[t]), int(tokens.end[t])))
                elif tag == secrets.INSIDE:
                    spans[-1] = (spans[-1][0], int(tokens.end[t]))
            raw = text.encode()
            assert found.get(k, []) == [(a, a + len(raw[a:b].rstrip(b".?-"))) for a, b in spans if raw[a:b].rstrip(b".?-")]


def test_added_secrets_on_lines_of_another_maker(spark, documents, sf_dir):
    """Recall on sentences and secrets that training doesn't make, spans of several tokens among them; nothing is added in the test tables' clean texts."""
    import string
    import uuid

    from docloom.llm.secrets import fit, scan

    r = random.Random(77)
    pick = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    kinds = {
        "token": lambda: pick(string.ascii_letters + string.digits, 32),
        "word": lambda: pick(string.ascii_lowercase, 6).capitalize() + pick(string.digits, 3) + "!",
        "groups": lambda: " ".join(pick(string.ascii_uppercase, 2) + pick(string.digits, 2) for _ in range(4)),
        "uuid": lambda: str(uuid.UUID(int=r.getrandbits(128))).upper(),
    }
    carriers = ["Hi Ana, for the wifi use password {} until Friday", "new credentials for the server {} please keep them", "his login was {} back then", "the api token {} stopped working"]
    texts, secrets = [], []
    for k in range(160):
        kind = sorted(kinds)[k % 4]
        secret = kinds[kind]()
        texts.append(r.choice(carriers).format(secret))
        secrets.append((kind, secret))
    clean = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet")
    field = fit(clean)
    got = by_id(scan(documents(texts), field))
    caught, of_groups = defaultdict(int), 0
    for i, (kind, secret) in enumerate(secrets):
        spans = [tuple(x.split(":")) for x in filter(None, got[i]["spans"].split(","))]
        at = texts[i].index(secret)
        touched = [s for s in spans if int(s[1]) < at + len(secret) and at < int(s[2])]
        caught[kind] += bool(touched)
        of_groups += kind == "groups" and any(int(s[1]) <= at and int(s[2]) >= at + len(secret) for s in touched)
    print("caught of 40 each:", dict(caught), "whole groups:", of_groups)
    assert min(caught.values()) >= 34 and len(caught) == 4 and of_groups >= 30
    assert scan(clean, field).where("spans like '%crf%'").count() <= 2


# --- 6: decontamination

def hits_by_force(texts, items):
    word = re.compile(rb"[0-9a-z\x80-\xff]+")
    tokens = lambda t: word.findall((t or "").encode().lower())
    windows = defaultdict(set)
    for i, t in items:
        w = tokens(t)
        for a in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[a : a + 10])].add("" if i is None else str(i))
    out = []
    for t in texts:
        w, hit, found = tokens(t), set(), set()
        for size in {len(x) for x in windows}:
            for a in range(len(w) - size + 1):
                if (key := tuple(w[a : a + size])) in windows:
                    found |= windows[key]
                    hit |= set(range(a, a + size))
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def test_decontamination(spark, documents, odd_texts, prose):
    from docloom.llm.decontaminate import digest, find, remove

    items = [(i, prose(n)) for i, n in enumerate((14, 25, 9, 3, 40, 10))] + [(10, None), (11, ""), (12, "..."), (None, prose(12)), (2, prose(11))]
    r = random.Random(5)
    texts = list(odd_texts)
    for k in range(80):
        parts = [prose(r.randrange(0, 25))]
        for _ in range(r.randrange(0, 3)):
            w = (r.choice(items)[1] or "").split()
            a = r.randrange(0, max(1, len(w) - 5))
            parts += [" ".join(w[a : a + r.randrange(5, 30)]).upper() if k % 2 else "; ".join(w[a:]), prose(r.randrange(0, 6))]
        texts.append(" ".join(parts))
    texts += [texts[20]] * 3
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = clashing(documents(texts))
    got = by_id(digest(find(docs, benchmark)))
    expected = hits_by_force(texts, items)
    assert [tuple(got[i][c] for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for i in range(len(texts))] == expected
    assert sum(x[4] for x in expected) > 10
    left = by_id(remove(documents(texts), benchmark))
    for i, t in enumerate(texts):
        if not expected[i][4]:
            assert left[i]["text"] == t
        else:
            assert hits_by_force([left[i]["text"]], [])[0][0] == expected[i][0] - expected[i][1]
    assert digest(find(documents([]), benchmark)).count() == 0
    assert find(documents(["a b"]), benchmark.limit(0)).first()["n_hit"] == 0


def test_fm_index_counts_and_locates():
    import numpy as np

    from docloom.llm.decontaminate import END, Index

    r = np.random.default_rng(6)
    for _ in range(20):
        lengths = r.integers(0, 40, size=r.integers(1, 8))
        text = np.concatenate([np.append(r.integers(1, 4, size=n), END) for n in lengths])
        offset = np.concatenate([np.arange(n + 1) for n in lengths])
        index = Index(text, offset, 4)
        table = np.array(list(itertools.product((1, 2, 3), repeat=3)))
        which, low, high = index.search(table, np.full(len(table), 3))
        found = {int(k): sorted(index.locate(np.arange(a, b)).tolist()) for k, a, b in zip(which, low, high)}
        for k, w in enumerate(table):
            assert found.get(k, []) == [i for i in range(len(text) - 2) if (text[i : i + 3] == w).all()]


# --- 7: BPE

def test_bpe_matches_the_library(documents, odd_texts):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from docloom.llm.bpe import encode_documents

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    r = random.Random(7)
    ranges = [(32, 127), (0x80, 0x600), (0x1E00, 0x2100), (0x3000, 0x3100)]
    texts = odd_texts + ["a<|endoftext|>b <|startoftext|>", "It'LL 'S we're 12½ ٣", "aab" * 400]
    texts += ["".join(chr(r.randrange(*r.choice(ranges))) for _ in range(r.randrange(1, 30))) for _ in range(150)]
    got = by_id(encode_documents(clashing(documents(texts)), path))
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i]["ids"] == ids and got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert encode_documents(documents([]), path).count() == 0


# --- 8: quality

def test_quality(spark, documents, odd_texts, prose):
    from docloom.llm.quality import classify, keep

    clean = [prose(40) for _ in range(300)]
    junk = [" ".join(w.upper() + "!!" for w in prose(40).split()) for _ in range(60)]
    texts = clean + junk + odd_texts
    docs = documents(texts)
    labels = spark.createDataFrame([(i, int(i < 300), 0) for i in range(0, 360, 2)] + [(None, 1, 0), (4, 1, None)], "doc_id long, quality int, toxic int")
    got = by_id(classify(clashing(docs), labels))
    assert len(got) == len(texts)
    assert sum(got[i]["kept"] for i in range(300)) >= 295 and sum(got[i]["kept"] for i in range(300, 360)) == 0
    kept = {r["doc_id"] for r in keep(docs, labels).collect()}
    assert kept == {i for i, r in got.items() if r["kept"]}
    assert all(r["kept"] for r in classify(docs, labels.limit(0)).collect())
    assert classify(documents([]), labels).count() == 0


def test_toxic_words_are_not_diluted(spark, documents, prose):
    from docloom.llm.quality import classify, keep

    r = random.Random(12)
    insults = ["idiotish", "wretchful", "vermin", "moronic", "scumbag"]
    texts = []
    for i in range(600):
        w = prose(r.randrange(30, 600)).split()
        for _ in range(2 if i % 5 == 0 else 0):
            w[r.randrange(len(w))] = r.choice(insults) + r.choice(["", "s", "ly"])
        texts.append(" ".join(w))
    docs = documents(texts)
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(0, 600) if i < 400], "doc_id long, quality int, toxic int")
    got = by_id(classify(docs, labels))
    unseen = range(400, 600)
    assert sum(got[i]["kept"] for i in unseen if i % 5 == 0) <= 2
    assert sum(not got[i]["kept"] for i in unseen if i % 5) <= 3
    assert {r["doc_id"] for r in keep(docs, labels).collect()} == {i for i, x in got.items() if x["kept"]}


def test_toxic_recall_on_labels_held_back(spark):
    from docloom.llm.quality import classify

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    kept = {r["doc_id"]: r["kept"] for r in classify(docs, labels.where("doc_id % 2 = 0")).collect()}
    held = [r for r in labels.where("doc_id % 2 = 1 and quality = 1").collect()]
    toxic, good = ([kept[r["doc_id"]] for r in held if r["toxic"] == t] for t in (1, 0))
    print("held-out toxic dropped", toxic.count(False), len(toxic), "good kept", sum(good), len(good))
    assert toxic.count(False) >= 0.85 * len(toxic)
    assert sum(good) >= 0.99 * len(good)


def test_quality_weights_are_log_ratios_of_likelihoods(spark, documents):
    """Against models of the n-grams themselves, without hashing (no two of these n-grams share a bucket)."""
    from math import log

    from docloom.llm.quality import BITS, SMOOTHING, classify, for_target

    import numpy as np

    r = random.Random(31)
    texts = [" ".join(r.choice(["ab", "ba", "cab"]) for _ in range(r.randrange(0, 9))) if k % 3 else " ".join(r.choice(["zz", "ab"]) for _ in range(4)) for k in range(40)]
    labels = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(40)], "doc_id long, quality int, toxic int")
    teaches = for_target(np.arange(40))

    def grams(t):
        w = t.split()
        return [[t[a : a + n] for n in (1, 2, 3) for a in range(len(t) - n + 1)], [("w", x) for x in w] + list(zip(w, w[1:], strict=False))]

    raw, target = ([defaultdict(int), defaultdict(int)] for _ in range(2))
    for k, t in enumerate(texts):
        for kind in (0, 1):
            for g in grams(t)[kind]:
                raw[kind][g] += 1
                target[kind][g] += bool(k % 3 and teaches[k])
    p = lambda of, g: log((of[g] + SMOOTHING) / (sum(of.values()) + SMOOTHING * (1 << BITS)))
    got = by_id(classify(documents(texts), labels))
    for k, t in enumerate(texts):
        expected = sum(p(target[kind], g) - p(raw[kind], g) for kind in (0, 1) for g in grams(t)[kind])
        assert got[k]["log_weight"] == pytest.approx(expected, abs=1e-6)


def test_gumbel_top_k_samples_by_the_weights():
    """Inclusion frequencies over seeds against drawing one by one, without replacement, in proportion to exp(weight)."""
    import numpy as np

    from docloom.llm.quality import noise

    weights, k, seeds = np.array([0.0, 1.0, -1.0, 0.5, 2.0, 0.0, -2.0]), 3, 6000
    share = np.exp(weights)
    exact = np.zeros(len(weights))
    for drawn in itertools.permutations(range(len(weights)), k):
        p, left = 1.0, share.sum()
        for i in drawn:
            p, left = p * share[i] / left, left - share[i]
        exact[list(drawn)] += p
    found = np.zeros(len(weights))
    for seed in range(seeds):
        found[np.argsort(weights + noise(list(range(len(weights))), seed))[-k:]] += 1
    assert np.abs(found / seeds - exact).max() < 0.025


def test_noise_decides_near_the_boundary(spark, documents):
    from docloom.llm.quality import classify

    r = random.Random(44)
    shares = [r.random() for _ in range(500)]
    texts = [" ".join(r.choice(["alpha", "beta"] if r.random() < x else ["ALFA!!", "BETA!!"]) for _ in range(8)) for x in shares]
    labels = spark.createDataFrame([(i, int(r.random() < x), 0) for i, x in enumerate(shares)], "doc_id long, quality int, toxic int")
    runs = [by_id(classify(documents(texts), labels, seed)) for seed in (1, 2)]
    kept = [{i for i, x in run.items() if x["kept"]} for run in runs]
    assert len(kept[0]) == len(kept[1]) < 500  # the size of the sample doesn't depend on the seed
    least = min(runs[0][i]["key"] for i in kept[0])
    undecided = kept[0] ^ kept[1]
    assert undecided and all(abs(runs[0][i]["log_weight"] - least) < 15 for i in undecided)
    by_weight = set(sorted(runs[0], key=lambda i: -runs[0][i]["log_weight"])[: len(kept[0])])
    assert kept[0] != by_weight


def test_kth_largest_is_exact(spark):
    from docloom.llm.quality import kth_largest

    r = random.Random(8)
    values = [r.choice([r.gauss(0, 100), 3.0, 1e-9 * r.random()]) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "key double")
    for k in (1, 2, 17, 250, 499):
        assert kth_largest(df, k) == sorted(values, reverse=True)[k - 1]


# --- 9: language

def test_language(spark, odd_texts):
    from docloom.llm.language import predict_documents

    r = random.Random(10)
    sounds = {"aa": ["the", "and", "ing", "er"], "bb": ["der", "sch", "ung", "ß"], "cc": ["ción", "ñ", "que", "los"]}
    rows = []
    for i in range(400):
        lang = r.choice(sorted(sounds))
        rows.append((i, " ".join("".join(r.choice(sounds[lang]) for _ in range(r.randrange(1, 4))) for _ in range(12)), None if i % 11 == 0 else lang, lang))
    rows += [(1000 + i, t, None, None) for i, t in enumerate(odd_texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, truth string")
    got = by_id(predict_documents(docs.selectExpr("*", "'q' AS Lang2", "'q' AS TEXT")))
    for i, t, _, truth in rows:
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert 0 <= got[i]["score"] <= 1
        if truth:
            assert got[i]["lang_pred"] == truth
        elif t is None or not any(c.isalpha() for c in t):
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
    assert predict_documents(docs.limit(0)).count() == 0
    assert {r["lang_pred"] for r in predict_documents(docs.where("lang is null")).collect()} == {"und"}


def test_language_against_counting_strings(documents):
    """The same predictions and posteriors as naive Bayes over the n-grams themselves (no two of which share a bucket), ties and repeated rows among them."""
    from math import exp, log

    from docloom.llm.language import BUCKETS, SMOOTHING, held_out, predict_documents

    r = random.Random(8)
    words = {"en": ["the", "cat"], "fr": ["le", "chat"], "es": ["el", "gato"]}
    langs = [r.choice(sorted(words)) for _ in range(40)]
    texts = [" ".join(r.choice(words[x]) for _ in range(r.randrange(1, 5))) for x in langs] + ["", None, "1 2 3", "the le el", "the le el"]
    langs += [None] * 5
    docs = documents(texts).select("doc_id", "text").join(documents(texts).sparkSession.createDataFrame(list(enumerate(langs)), "doc_id long, lang string"), "doc_id")
    teach = {x["doc_id"] for x in docs.where(~held_out()).collect()}
    grams = lambda t: [t[a : a + n] for n in (1, 2, 3) for a in range(len(t) - n + 1)]
    counts, many = {x: defaultdict(int) for x in sorted(words)}, defaultdict(int)
    for i, (t, x) in enumerate(zip(texts, langs)):
        if i in teach and x:
            many[x] += 1
            for g in grams(t):
                counts[x][g] += 1
    got = by_id(predict_documents(docs))
    for i, t in enumerate(texts):
        if not t or not any(c.isalpha() for c in t):
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
            continue
        joint = {x: log(many[x] / sum(many.values())) + sum(log((counts[x][g] + SMOOTHING) / (sum(counts[x].values()) + SMOOTHING * BUCKETS)) for g in grams(t)) for x in counts}
        best = max(joint, key=joint.get)
        assert got[i]["lang_pred"] == best
        assert got[i]["score"] == pytest.approx(1 / sum(exp(v - joint[best]) for v in joint.values()))
    assert got[43] | {"doc_id": 0} == got[44] | {"doc_id": 0, "held_out": got[43]["held_out"]}


# --- 10: WARC

def test_warc_round_trip(spark):
    from docloom.llm.warc import archive_pages

    html = [None, "", "<p>é</p>", "a\r\n\r\nb\x00", "x" * 300_000, "<p>é</p>", "<p>é</p>", "<b>"]
    rows = [(i, None if i == 3 else f"http://www.X.example.com:80/a%20b?i={i}", h) for i, h in enumerate(html)] + [(2, "http://x/", "<p>é</p>")]
    out = archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS HTML"))
    got = sorted(out.collect(), key=lambda r: (r["page_id"], r["url"] or ""))
    assert len(got) == len(rows)
    assert sorted((r["page_id"], r["url"] or "") for r in got) == sorted((i, u or "") for i, u, _ in rows)
    newest = {}
    for i, _, h in rows:
        newest[h or ""] = max(newest.get(h or "", -1), i)
    for r in got:
        h = (html[r["page_id"]] or "")
        raw = h.encode()
        assert r["payload_bytes"] == len(raw) and r["payload_digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        first = newest[h]
        assert (r["record_type"], r["refers_to"]) == (("response", None) if r["page_id"] == first else ("revisit", first))
    assert archive_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_capture_index_lookup(spark, tmp_path, monkeypatch):
    from docloom.llm import warc

    rows = [(i, f"http://h{i % 7}.example.org/p/{i % 50}", f"<p>{i}</p>") for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    archives, index = f"file://{tmp_path}/warc", f"file://{tmp_path}/index"
    warc.write_archives(pages, archives)
    monkeypatch.setattr(warc, "LINES", 13)
    warc.build_index(spark, archives, index)
    lookup = warc.Lookup(spark, index)
    assert len(lookup.directory.first) >= 200 // 13
    for url in {u for _, u, _ in rows[:20]}:
        found = [lookup.read(*x) for x in lookup.captures(url)]
        assert sorted(x["page_id"] for x in found) == sorted(i for i, u, _ in rows if u == url)
        assert all(x["url"] == url and x["payload"] == f"<p>{x['page_id']}</p>".encode() for x in found)
    some = spark.createDataFrame([(u,) for _, u, _ in rows[:20]] + [("http://nowhere/",)], "url string")
    got = warc.fetch(warc.look_up(some, index)).collect()
    assert sorted(r["page_id"] for r in got) == sorted(i for i, u, _ in rows if u in {x for _, x, _ in rows[:20]})
    every = {(r["archive"], r["place"], r["length"]): r for r in warc.read_archives(spark, archives).collect()}
    assert len(every) == 200 and all(every[r["archive"], r["place"], r["length"]] == r for r in got)
    assert lookup.captures("http://h0.example.org/nowhere") == [] and lookup.captures("http://zz.example/") == []


def test_one_url_with_most_captures_and_long_keys(spark, monkeypatch):
    from docloom.llm import warc

    monkeypatch.setattr(warc, "LINES", 20)
    long = "http://long.example/" + "x" * 400
    rows = [(i, "http://hot.example/" if i % 3 else long + str(i % 2), None if i % 5 else f"{i}") for i in range(300)] + [(None, None, "p"), (None, "no scheme", "p")]
    out = warc.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r["page_id"] or -1, r["url"] or "") for r in out) == sorted((i or -1, u or "") for i, u, _ in rows)


def test_archives_are_gzip_files_of_warc_records(spark, tmp_path):
    import gzip
    from pathlib import Path

    from docloom.llm.warc import write_archives

    write_archives(spark.createDataFrame([(1, "http://a/", "<p>"), (2, "http://b/", "é")], "page_id long, url string, html string"), f"file://{tmp_path}/w")
    data = b"".join(gzip.decompress(p.read_bytes()) for p in Path(tmp_path, "w").glob("part-*"))
    assert data.count(b"WARC/1.1\r\n") == 2 and data.count(b"\r\n\r\nHTTP/1.1 200 OK") == 2


# --- stages keep other columns, also those whose names clash

def test_stages_keep_other_columns(spark, documents):
    from docloom.llm import decontaminate, jaccard, quality, secrets

    docs = documents([f"a b c d e f {SECRET}", f"a b c d e f {SECRET}", None, "x y"]).selectExpr("*", "'k' AS extra")
    benchmark = spark.createDataFrame([(1, "b c d")], "item_id long, text string")
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    clash = docs.selectExpr("'q' AS TEXT", "7 AS Doc_Id", "*")
    for make, rows in ((lambda d: quality.keep(d, labels), 4), (lambda d: jaccard.keep_one(d, 5, (80, 100)), 3), (lambda d: decontaminate.remove(d, benchmark), 4), (secrets.redact, 4)):
        out = make(docs)
        assert out.columns == docs.columns and out.count() == rows and {r["extra"] for r in out.collect()} == {"k"}
        other = make(clash)
        assert other.columns == clash.columns and other.count() == rows
    assert decontaminate.remove(docs.drop("n_chars"), benchmark).first()["text"].startswith("a  e f")


# --- repeated rows, ties and clashing names

def test_repeated_rows_have_repeated_results(spark, documents, prose):
    import public_tokenizers

    from docloom.llm import bpe, jaccard, language, quality, secrets

    texts = [prose(30) for _ in range(12)] + ["password: abcdefghijkl12", "", None]
    once = documents(texts)
    twice = once.unionAll(once)
    labels = spark.createDataFrame([(i, int(i % 2), 0) for i in range(12)], "doc_id long, quality int, toxic int")
    for run in (secrets.scan, lambda d: bpe.encode_documents(d, public_tokenizers.path("word_bpe_49k.json")), lambda d: quality.classify(d, labels), language.predict_documents, jaccard.cluster):
        rows = [tuple(map(str, r)) for r in run(clashing(twice)).collect()]
        assert len(rows) == 2 * len(texts) and all(rows.count(r) % 2 == 0 for r in rows)


def test_ties_at_the_boundary_are_all_kept(spark, documents):
    from docloom.llm.quality import classify

    texts = ["good words here"] * 10 + ["BAD!! JUNK!!"] * 10
    labels = spark.createDataFrame([(i, int(i < 10), 0) for i in range(20)], "doc_id long, quality int, toxic int")
    rows = documents(texts, [i % 5 + (10 if i >= 10 else 0) for i in range(20)])  # each row twice
    kept = defaultdict(set)
    for r in classify(rows, labels).collect():
        kept[r["doc_id"]].add(r["kept"])
    assert all(len(v) == 1 for v in kept.values())


def test_top_k_with_clashing_names_and_repeated_vectors(spark):
    from docloom.llm.topk import top_k

    df = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(101)] + [(7, [2.0, 1.0]), (None, [9.0, 9.0])], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in top_k(df.selectExpr("*", "1 AS VEC_ID", "2 AS Embedding")).orderBy("query_id", "rank").collect()]
    rows = [(i, [256 * (i % 3), 256]) for i in range(101)] + [(7, [512, 256])]
    expected = []
    for q in (0, 50, 100):
        v = dict(rows[:101])[q]
        best = sorted(((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q))[:5]
        expected += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == expected


def test_near_copies_in_a_large_group(documents, prose):
    """A group of a few hundred different near copies, in blocks of a few: every document's number of links, and one component."""
    from docloom.llm import jaccard

    r = random.Random(90)
    base = [f"w{k}" for k in range(120)]
    texts = []
    for _ in range(220):
        w = list(base)
        for _ in range(r.randrange(0, 4)):
            w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
        texts.append(" ".join(w))
    texts += texts[:15] + [" ".join(f"other{k}" for k in range(100))]
    sets = [frozenset(tuple(t.split()[a : a + 4]) for a in range(len(t.split()) - 3)) for t in texts]
    fits = lambda a, b: 100 * len(a & b) >= 85 * len(a | b)
    expected = [sum(fits(x, y) for j, y in enumerate(sets) if j != i) for i, x in enumerate(sets)]
    blocks = jaccard.BLOCK_SKETCHES, jaccard.BLOCK_SETS
    jaccard.BLOCK_SKETCHES, jaccard.BLOCK_SETS = 50, 30
    try:
        got = by_id(jaccard.cluster(documents(texts)))
    finally:
        jaccard.BLOCK_SKETCHES, jaccard.BLOCK_SETS = blocks
    assert [got[i]["n_links"] for i in range(len(texts))] == expected
    assert [got[i]["component_id"] for i in range(len(texts))] == [c for _, c in components_by_force(texts, 4, (85, 100))]
