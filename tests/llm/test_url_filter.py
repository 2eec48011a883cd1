import datetime as dt

from marginalia.llm.url_filter import judge_captures


def brute(captures, entries):
    out = []
    for i, host, when in captures:
        found = []
        labels = host.split(".")
        for name in {".".join(labels[k:]) for k in range(len(labels))} if host else set():
            lines = {}
            for d, c, a, t in entries:
                if d and c and t and a in ("add", "remove") and d.lower() == name and when and t <= when:
                    lines.setdefault(c, []).append((t, a))
            found += [(c, name) for c, x in lines.items() if max(x)[1] == "add"]
        longest = max((n for _, n in found), key=lambda n: (len(n), n), default=None)
        out.append((i, sorted({c for c, _ in found}), longest, bool(found)))
    return sorted(out, key=str)


def day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def test_as_of_equals_a_replay(spark):
    import random

    rnd = random.Random(8)
    hosts = ["a.b.com", "b.com", "x.a.b.com", "c.org", "q.c.org", "com"]
    entries = [(rnd.choice(hosts).upper() if k % 3 else rnd.choice(hosts), rnd.choice("pq"), rnd.choice(["add", "remove"]), day(rnd.randint(0, 30))) for k in range(120)]
    entries += [(None, "p", "add", day(1)), ("b.com", None, "add", day(1)), ("b.com", "p", "add", None), ("b.com", "p", "noise", day(2))]
    seen = [(k, rnd.choice(hosts), day(rnd.randint(-2, 33))) for k in range(200)] + [(900, "b.com", None), (901, "", day(5))]
    rows = [(i, f"https://u@WWW.{h}:80/p?q#f" if h else "no url", t) for i, h, t in seen] + [(902, None, day(3))]
    df = spark.createDataFrame(rows, "page_id long, url string, fetched_at timestamp").selectExpr("*", "1 AS domain", "2 AS valid_to", "3 AS blocked", "4 AS _host", "5 AS _from", "6 AS _longest", "7 AS listed", "8 AS since", "9 AS row")
    got = judge_captures(df, spark.createDataFrame(entries, "domain string, category string, action string, at timestamp"))
    have = sorted(((r["page_id"], list(r["categories"]), r["matched_domain"], r["blocked"]) for r in got.collect()), key=str)
    assert have == brute(seen + [(902, "", day(3))], entries)


def test_repeated_rows_and_empty_tables(spark):
    e = spark.createDataFrame([("b.com", "p", "add", day(0))], "domain string, category string, action string, at timestamp")
    c = spark.createDataFrame([(1, "http://b.com", day(1))] * 3, "page_id long, url string, fetched_at timestamp")
    assert [r["blocked"] for r in judge_captures(c, e).collect()] == [True] * 3
    assert [r["blocked"] for r in judge_captures(c, e.limit(0)).collect()] == [False] * 3
    assert judge_captures(c.limit(0), e).count() == 0
