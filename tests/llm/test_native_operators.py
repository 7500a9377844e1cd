"""URL filter, sharding, line dedup and PII against brute force."""

import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from veilframe.llm import linededup, pii, sharding, urlfilter


def plain_verdict(url, rules, listed):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule = max(fits) if fits else None
    bare, clean = re.sub(r":(80|443)?$", "", re.sub(r"^.*@", "", host)), re.sub("/+", "/", path)
    on = [e for e in listed if (bare == e.split("/")[0] or bare.endswith("." + e.split("/")[0])) and clean.startswith(e[len(e.split("/")[0]) :])]
    return host, path, rule and rule[2], rule[3] if rule else "block" if on else "allow"


@pytest.mark.parametrize("small", [True, False])
def test_url_filter(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(urlfilter, "BROADCAST_ROWS", 0)
    rng = random.Random(1)
    hosts = ["a.com", "com", "xcom", "example.com", "www.example.com", "deep.www.EXAMPLE.com", "x.net", "net", "b.org", "spam-farm.example.org", "m.spam-farm.example.org:443", "u@spam-farm.example.net"]
    paths = ["", "/", "/en/", "/en", "/es/x?y=/fr/", "/fr/#z", "//fr/", "/x;y"]
    urls = [f"http://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(150)] + [None, "", "no url", "://", "http://", "a://b://c.com/", "http://a.com?x=/", "http://a.com#/"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    rules = spark.createDataFrame(list(urlfilter.RULES), "verdict string, host string, path string")
    listed = spark.createDataFrame([(x,) for x in urlfilter.LISTED], "entry string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(pages, rules, listed).collect()}
    assert got == {i: plain_verdict(u, urlfilter.RULES, urlfilter.LISTED) for i, u in enumerate(urls)}
    assert urlfilter.judge(pages.limit(0), rules, listed).count() == 0
    assert {r.verdict for r in urlfilter.judge(pages, rules.limit(0), listed.limit(0)).collect()} == {"allow"}


def test_bloom_filter_has_no_false_negatives(spark):
    keys = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    other = spark.range(3000, 6000).select(F.concat(F.lit("k"), "id").alias("key"))
    assert urlfilter.listed_hits(keys.union(other), keys).count() == 3000


def test_shards(spark, docs):
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab\u00e9 ") for _ in range(rng.randint(0, 400))) for _ in range(600)] + ["same text"] * 300 + [None, ""]
    table = docs(*texts, (None, "x"), (5, "y"), (5, "y"))
    rows = sharding.shards(table.withColumn("shard", F.lit("clash"))).collect()
    assert len(rows) == table.count()
    sizes, slots = {}, {}
    for r in rows:
        sizes[r.shard] = sizes.get(r.shard, 0) + r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert sorted(sizes) == list(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    most = max(r.size for r in rows) + sum(sizes.values()) // 8 // sharding.GROUP_PART + 1
    assert max(sizes.values()) - min(sizes.values()) <= 2 * most
    by = {r.doc_id: r for r in rows}
    assert all(by[i].size == len(t.encode()) + 1 and by[i].text_crc32 == zlib.crc32(t.encode()) for i, t in enumerate(texts) if t and i != 5)
    assert by[texts.index(None)].size == 1 and by[texts.index(None)].text_crc32 == 0
    assert sharding.shards(table.limit(0)).count() == 0


def plain_line_dedup(rows, least=50):
    """Lines to delete: those in a run of consecutive worded lines that occurs earlier."""
    lines = {i: [(k, x) for k, x in enumerate(t.split("\n")) if x.split()] for i, t in rows if t is not None}
    seen, out = {}, {i: set() for i in lines}
    order = [(i, a, b) for i in sorted(lines) for a in range(len(lines[i])) for b in range(a + 1, len(lines[i]) + 1)]
    runs = {}
    for i, a, b in order:
        part = lines[i][a:b]
        if sum(len(x.split()) for _, x in part) >= least:
            runs.setdefault(tuple(x for _, x in part), []).append((i, part[0][0], part[-1][0]))
    for places in runs.values():
        first = min(places)
        for i, a, b in places:
            if i != first[0] or a > first[2]:
                out[i].update(range(a, b + 1))
    return out


def test_line_dedup(spark, docs):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(40)]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [[line(n) for n in ns] for ns in ((20, 10, 30), (60,), (10, 60, 10), (5, 5, 5), (25, 24))]
    texts = [None, "", "\n\n", line(200)]
    for _ in range(25):
        parts = [line(rng.randint(1, 30)) for _ in range(rng.randint(0, 4))]
        for _ in range(rng.randint(0, 3)):
            block = rng.choice(shared)
            at = rng.randint(0, len(parts))
            parts[at:at] = block[: rng.randint(1, len(block))] if rng.random() < 0.3 else block
            if rng.random() < 0.3:
                parts.insert(at + 1, "")
        texts.append("\n".join(parts))
    texts += [texts[-1], "\n".join([line(30)] * 2), "\n".join(["a b c d e f g h i j"] * 30)]
    table = docs(*texts)
    got = {r.doc_id: r for r in linededup.delete_repeated(table.withColumn("removed", F.lit(1))).collect()}
    want = plain_line_dedup(list(enumerate(texts)))
    for i, t in enumerate(texts):
        kept = got[i].text
        gone = {k for part in filter(None, got[i].removed.split(",")) for k in range(int(part.split("-")[0]), int(part.split("-")[1]) + 1)}
        blank = {k for k, x in enumerate((t or "").split("\n")) if not x.split()}
        assert gone - blank == want.get(i, set()) - blank, i
        assert kept == (None if t is None else t if not gone else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone))
    assert linededup.delete_repeated(table.limit(0)).count() == 0
    twice = linededup.delete_repeated(docs((1, line(60)), (1, texts[3]), (1, texts[3]), (None, texts[3])))
    assert twice.count() == 4 and {r.text for r in twice.where("doc_id = 1").collect()} != {""}


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - (9 if c > "4" else 0) for i, c in enumerate(reversed(d))) % 10 == 0


def plain_spans(text):
    out = []
    for k, (kind, p) in enumerate(BASE.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x for _, _, x in sorted(out))


def test_base_spans(spark, docs):
    rng = random.Random(8)
    texts = [None, "", "4111 1111 1111 1111", "1" * 30000, "a" * 30000, "1 " * 20000, "a@b.c " * 300, "+1" + "(" * 20000, "+1 (988) 555-2485 108.51.216.133 \U0001f600 a@b.co"]
    for alphabet in ("a1.@+- 4(b)9\u00e9\U0001f600", "0123456789 -.", "a.@-b_", "+1234567890() .-"):
        texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 70))) for _ in range(300)]
    got = {r.doc_id: r.s for r in pii.find(docs(*texts)).select("doc_id", pii._listed(F.concat(*pii.KINDS)).alias("s")).collect()}
    assert got == {i: plain_spans(t) for i, t in enumerate(texts)}


def plain_terms(texts, support=3, share=0.85, smoothing=1):
    """Disclosing terms by counting every entity with every term."""
    texts = [t for t in texts if t]
    of_text = {}
    for t in set(texts):
        entities, plain = set(), re.sub(BASE["email"], " ", t)
        for kind, at in ((x.split(":")[0], x.split(":")) for x in plain_spans(t).split(",") if x):
            value = t[int(at[1]) : int(at[2])]
            d = re.sub("[^0-9]", "", value)
            part = {"email": value.lower().split("@")[-1], "ip": ".".join(value.split(".")[:2]), "card": d[:6], "phone": d[:4]}[kind]
            entities |= {"any", kind, f"{kind}:{part}", f"{kind}={d if kind in ('card', 'phone') else value.lower()}"}
        of_text[t] = entities, {w for w in re.split(r"[\W_]+", plain.lower()) if w and not re.fullmatch("[0-9]+", w)}
    n_e, n_t, n_et, support_of = Counter(), Counter(), Counter(), Counter()
    for t in texts:
        n_e.update(of_text[t][0])
        n_t.update(of_text[t][1])
        n_et.update((e, w) for e in of_text[t][0] for w in of_text[t][1])
    for entities, words in of_text.values():
        support_of.update((e, w) for e in entities for w in words)
    out = {}
    for (e, w), n in n_et.items():
        if support_of[e, w] >= support and n_e[e] < len(texts):
            told = math.log2(n / (n_t[w] + smoothing) * len(texts) / n_e[e]) / math.log2(len(texts) / n_e[e])
            if told > share:
                out[w] = max(told, out.get(w, 0))
    return out


@pytest.mark.parametrize("n_set", [10_000, 0])
def test_disclosing_terms(spark, docs, monkeypatch, n_set):
    monkeypatch.setattr(pii, "SET_TERMS", n_set)
    rng = random.Random(9)
    filler = lambda: " ".join(rng.choice(["river", "stone", "house", "water", "light", "Stra\u00dfe", "17"]) for _ in range(12))
    texts = [f"{filler()} Zorblatt {'wrote ' * (i % 3)}from ann@site.org {filler()} {i}" for i in range(9)]
    texts += [f"{filler()} quimby u{i}@mail.net {filler()}" for i in range(5)] + [f"brux{i} +1 (234) 555-000{i} {filler()} vorta" for i in range(6)]
    texts += [f"copied word hapax 10.20.30.40 {filler()}"] * 7 + [f"{filler()} {i}" for i in range(400)] + [None, "", "Zorblatt was here", "wrote", "QUIMBY quimby"]
    table = docs(*texts)
    told = {r.term: r.share for r in pii.disclosing_terms(table).collect()}
    want = plain_terms(texts)
    assert told == pytest.approx(want) and {"zorblatt", "quimby", "vorta"} <= told.keys() and "hapax" not in told
    rows = {r.doc_id: r for r in pii.find(table.withColumn("veil_terms", F.lit("clash"))).collect()}
    for i, t in enumerate(texts):
        base = [range(s.start, s.end) for k in pii.KINDS for s in rows[i][k]]
        spans = sorted((m.start(), m.end(), "removed" if told[w] > pii.REMOVE else "term") for w in told for m in re.finditer(rf"(?i)(?<![^\W_]){re.escape(w)}(?![^\W_])", t or "") if not any(m.start() in b for b in base))
        assert [(s.start, s.end, s.kind) for s in rows[i].term] == spans
    clean = {r.doc_id: r for r in pii.sanitise(table.withColumn("term", F.lit("clash"))).collect()}
    assert "ann@site.org" not in clean[0].text and "<EMAIL>" in clean[0].text and not re.search("(?i)zorblatt", clean[0].text) and clean[0].term == "clash"
    assert [clean[texts.index(t)].text for t in (None, "")] == [None, ""]
    assert pii.find(table.limit(0)).count() == 0
