"""Rules and Markov models against plain Python."""

import math
import zlib
from collections import Counter

from cedarflow.llm import urlfilter as uf


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    return host, path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]


def said(url):
    """What the models read: all behind the first ://, or all."""
    return (url or "").split("://", 1)[-1]


def rule(host, path):
    fit = [(len(h + p), h + p, v) for v, h, p in uf.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, None)


def classes(text):
    out = [0, 0]
    for c in text:
        c = c.lower() if "A" <= c <= "Z" else c
        c = "0" if c in "123456789" else c
        out.append(max(0, (uf.ALPHABET.find(c) if c in uf.ALPHABET and c not in "^~" else uf.ALPHABET.find("~"))))
    return [*out, 0]


def brute(pages):
    rows = [(i, u, *parts(u)) for i, u in pages]
    rows = [(i, u, h, p, *rule(h, p), classes(said(u))) for i, u, h, p in rows]
    known = [(r, zlib.crc32(r[1].encode()) % 5 == 0) for r in rows if r[4]]
    A, n = uf.A, [Counter(), Counter()]
    for r, held in known:
        if not held:
            n[r[5] == "block"].update((r[6][i] * A + r[6][i + 1]) * A + r[6][i + 2] for i in range(len(r[6]) - 2))
    ratio = Counter()
    if n[0] and n[1]:
        logs = []
        for k in (0, 1):
            u, b, B, D, N, T = Counter(), Counter(), Counter(), Counter(), Counter(), Counter()
            for g, c in n[k].items():
                u[g % A] += c
                b[g % (A * A)] += c
                N[g // A] += c
                T[g // A] += 1
            for g, c in b.items():
                B[g // A] += c
                D[g // A] += 1
            U, V = sum(u.values()), len(u)
            log = {}
            for g in range(A**3):
                p = (u[g % A] + V / A + 1 / A) / (U + V + 1)
                one, two = g % (A * A) // A, g // A
                p = (b[g % (A * A)] + D[one] * p) / (B[one] + D[one]) if B[one] else p
                p = (n[k][g] + T[two] * p) / (N[two] + T[two]) if N[two] else p
                log[g] = math.log(p)
            logs.append(log)
        ratio = {g: math.floor(abs((logs[1][g] - logs[0][g]) * uf.UNIT) + 0.5) * (1 if logs[1][g] >= logs[0][g] else -1) for g in range(A**3)}
    score = lambda cs: math.floor(sum(ratio[(cs[i] * A + cs[i + 1]) * A + cs[i + 2]] for i in range(len(cs) - 2)) / max(1, len(cs) - 2))
    width = uf.UNIT // 100
    held = [(max(-uf.BINS, min(uf.BINS, math.floor(score(r[6]) / width))), r[5]) for r, h in known if h]
    n0, n1 = sum(v == "allow" for _, v in held), sum(v == "block" for _, v in held)
    least = 2 * uf.BINS * width
    if n0 and n1:
        best = max((sum(v == "allow" and b <= c for b, v in held) / n0 + sum(v == "block" and b > c for b, v in held) / n1, c) for c in range(-uf.BINS, uf.BINS + 1))
        least = (best[1] + 1) * width - 1
    return sorted((str(i), h, p, str(name), v or ("block" if said(u) and score(cs) > least else "allow")) for i, u, h, p, name, v, cs in rows)


def test_brute_force(spark):
    pages = [(r["page_id"], r["url"]) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url").collect()]
    pages += [(1000, None), (1001, ""), (1002, "no scheme"), (1003, "HTTP://WWW.Example.ORG/es/x?y"), (1004, "a://b://c.org/"), (1005, "x://org"), (1006, "x://org/"), (1007, "http://é.example.net/ü\n/?#"), (1007, "http://é.example.net/ü\n/?#"),
              (None, "x://notorg/"), (1008, "http://example.org/en/1" + "9" * 5000), (1009, "x://h?://z/"), (1010, "#"), (1011, "http://#a"), (1012, "http://h.net/a?" + "q=1&" * 3000)]
    df = spark.createDataFrame(pages, "page_id long, url string")
    got = sorted((str(r["page_id"]), r["host"], r["path"], str(r["rule"]), r["verdict"]) for r in uf.judge_urls(df).collect())
    assert got == brute(pages)
    assert len({v for *_, r, v in got if r == "None"}) == 2


def test_without_training_rows(spark):
    df = spark.createDataFrame([(1, "http://a.net/x", 3), (2, None, 3)], "page_id long, url string, score int")
    assert {r["verdict"] for r in uf.judge_urls(df).collect()} == {"allow"}
    assert uf.judge_urls(df.limit(0)).count() == 0


def test_query_string_and_fragment_count(spark):
    pages = [f"http://h{i}.org/a?{'q' * 9}{i}" for i in range(80)] + [f"http://example.org/es/a?{'v' * 9}{i}" for i in range(80)] + ["http://x.net/a?qqqqqqqqq", "http://x.net/a?vvvvvvvvv", "http://x.net/a#vvvvvvvvv"]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(pages)], "page_id long, url string, host string")
    score = {r["page_id"]: r["score"] for r in uf.judge_urls(df).collect()}
    assert score[160] < 0 < score[161] and score[160] < score[162]


def test_no_join_without_keys(spark):
    df = spark.createDataFrame([(1, "http://a.org/x", "k")], "page_id long, url string, k string")
    plan = uf.model(uf.url_rows(df).withColumn("cs", uf.classes(uf.F.col("said"))).withColumn("ruled", uf.F.lit("allow")))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
