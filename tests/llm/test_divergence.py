"""The divergence audit against plain whole-number loops over all terms."""

import random
import re
from collections import Counter, defaultdict

import pytest
from bindery.llm import divergence
from bindery.llm.divergence import divergence_audit

SCHEMA = "doc_id bigint, lang string, source string, text string, term string, p int, block string, kept int, value int"


def brute_force(rows, least, top):
    documents = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))) for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in documents}:
        seen = Counter(t for own, _, terms in documents if own == lang for t in set(terms))
        kept = sorted(t for t, n in seen.items() if n >= least)
        counts = defaultdict(Counter)
        for own, source, terms in documents:
            if own == lang:
                counts[source].update(t for t in terms if t in set(kept))
        whole = sum(counts.values(), Counter())

        def shares(count):
            total = sum(count.values())
            return {t: 1 + 1_000_000_000 * (count[t] + 2) // (total + 2 * len(kept)) for t in kept}

        of, all_of = {s: shares(c) for s, c in counts.items()}, shares(whole)

        def listed(source, part, items, most=None):
            ranked = sorted(items, key=lambda i: (-i[1], i[0].encode()))[:most]
            out.extend((lang, source, part, item, value, n) for n, (item, value) in enumerate(ranked, 1))

        for source, p in of.items():
            listed(source, "pair", [(other, sum((p[t] - q[t]) ** 2 // (p[t] + q[t]) for t in kept)) for other, q in of.items() if other != source])
            listed(source, "term", [(t, (p[t] - all_of[t]) ** 2 // (p[t] + all_of[t])) for t in kept if counts[source][t] and p[t] > all_of[t]], top)
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(12)
    words = ["the", "The", "a1b", "ÄÖ", "ß", "x_y", "don't", "中文", "É", "é", "\x85", "z"] + ["".join(rng.choices("abcdE", k=3)) for _ in range(40)]
    rows = [(rng.choice(["en", "en", "en", "de", None, ""]), rng.choice(["s0", "s0", "s1", "s2", "Ü", None]), " ".join(rng.choices(words, k=rng.randint(0, 30)))) for _ in range(150)]
    rows += [("fr", "lonely", "one two"), ("es", "e1", "unique words"), ("es", "e2", None), ("es", "e3", ""), (None, None, None), ("en", "empty", None), ("en", "numbers", "12 34")]
    return rows + [rows[0]] * 3


def frame(spark, rows):
    return spark.createDataFrame([(None if n % 7 == 0 else n, *r, "t", 1, "b", 2, 3) for n, r in enumerate(rows)], SCHEMA).repartition(3)


@pytest.mark.parametrize("blocks", [{}, {"block_groups": 1, "block_terms": 5}, {"block_groups": 2, "block_terms": 50}])
def test_against_loops(spark, corpus, blocks):
    found = divergence_audit(frame(spark, corpus), least=4, top=5, **blocks)
    assert dict(found.dtypes) == {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"}
    rows = sorted(map(tuple, found.collect()))
    assert rows == sorted(brute_force(corpus, 4, 5))
    assert {r[4] for r in rows if r[0] == "es" and r[2] == "pair"} == {0}
    assert not [r for r in rows if r[0] == "fr"]


def test_sums_passed_on_early(spark, corpus, monkeypatch):
    monkeypatch.setattr(divergence, "HELD_TERMS", 3)
    monkeypatch.setattr(divergence, "CHUNK_BYTES", 10)
    found = divergence.count_terms(frame(spark, corpus).fillna("").select("lang", "source", "text"))
    wanted, seen = Counter(), Counter()
    for lang, source, text in corpus:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        wanted.update((lang or "", source or "", t) for t in terms)
        seen.update((lang or "", source or "", t) for t in set(terms))
    assert sorted(map(tuple, found.collect())) == sorted((*k, n, seen[k]) for k, n in wanted.items())


def test_long_text(spark):
    text = "word " * 300_000 + "w" * 2_000_000 + " 1 end"
    rows = [("en", "a", text), ("en", "b", "end word"), ("en", "a", "word")]
    found = divergence_audit(frame(spark, rows), least=2)
    assert sorted(map(tuple, found.collect())) == sorted(brute_force(rows, 2, 10))


def test_no_rows(no_documents):
    docs = no_documents.selectExpr("doc_id", "text", "hash AS lang", "spans AS source")
    assert divergence_audit(docs).count() == 0
