"""Terms that disclose entities of the corpus, against what the counts say."""

import re
from collections import Counter, defaultdict
from math import log2

from tidemark.llm import pii

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def found(spark, rows):
    d = spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], SCHEMA)
    spans = {r.doc_id: [(t.s, t.e) for t in r.terms] for r in pii.find(d).collect()}
    return spans, {r.doc_id: r.text for r in pii.redact(d).collect()}


def others(n):
    return [(100 + i, f"about the plan writes to number nobody {i}") for i in range(n)]


def test_terms_of_entities_in_one_or_two_documents(spark):
    rows = [(0, "zorbex writes to hidden@corp.com about the plan"),
            (1, "quimble writes to 10.1.2.3 about the plan"), (2, "quimble writes to 10.1.2.3 about the plan")]
    spans, text = found(spark, rows + others(60))
    assert spans[0] == [(0, 6)] and spans[1] == spans[2] == [(0, 7)]
    assert text[0] == " writes to [EMAIL] about the plan" and text[1] == " writes to [IP] about the plan"
    assert all(spans[i] == [] for i, _ in others(60))


def test_terms_of_the_whole_document(spark):
    far = "about the plan " * 10
    rows = [(0, f"Bo Zorbex {far}user zb77q, then 李明 and 我见王芳了 {far}Zorbex mailed hidden@corp.com; zorbex")]
    spans, text = found(spark, rows + others(30) + [(200, "about the plan user then and mailed"), (201, "我见到了他"),
                                                    (202, "user then and mailed")])
    marked = [rows[0][1][s:e] for s, e in spans[0]]
    assert {"Bo", "Zorbex", "zorbex", "zb77q", "李明", "王芳"} <= set(marked)
    assert marked.count("Zorbex") == 2 and not {"about", "the", "plan"} & set(marked)
    assert not re.search("bo |zorbex|zb77q|李|王芳", text[0].lower())


def test_disclosing_terms_against_counts(spark):
    names = [f"n{i}" for i in range(12)]
    rows = [(i, " ".join([names[i % 12], names[i * 5 % 7], f"id{i // 3}", "common", f"w{i % 4}x"]
                         + [f"{c}@corp.com" for c in ("ab", "cd", "ef")[:i % 4] if i < 40] + [f"tail{i % 9}"]))
            for i in range(300)]
    held, having, both = defaultdict(set), Counter(), Counter()
    terms = {i: Counter(re.findall(r"\w{2,}", re.sub(r"\S+@\S+", " ", t))) for i, t in rows}
    for i, t in rows:
        held[i] = set(re.findall(r"\S+@\S+", t))
        having.update(set(re.findall(r"\w{2,}", t)))
        both.update((e, w) for e in held[i] for w in terms[i])
    n_e, n = Counter(e for h in held.values() for e in h), len(rows)
    rule = {(e, w) for (e, w), k in both.items()
            if log2(k * n / (n_e[e] * having[w])) / log2(n / n_e[e]) >= pii.Policy().disclose}
    want = {i: sorted(m.span() for m in re.finditer(r"\w{2,}", re.sub(r"\S+@\S+", lambda m: " " * len(m[0]), t))
                      if any((e, m[0]) in rule for e in held[i])) for i, t in rows}
    spans, _ = found(spark, rows)
    assert rule and spans == want


def test_random_corpora_against_counts(spark):
    """Counts, PMI over information content and marks by plain Python, over corpora with repeated rows and shared entities."""
    import random

    rng = random.Random(4)
    rows = []
    for i in range(150):
        words = rng.choices(["alpha", "beta", "gamma", "delta", "Eps", "zeta1", "eta"] + [f"r{i % 11}q", f"s{i % 37}", f"only{i}"], k=rng.randint(3, 14))
        mails = [f"m{rng.randint(0, 25)}@corp.com" for _ in range(rng.choice([0, 0, 1, 1, 2, 3]))]
        mixed = words + mails
        rng.shuffle(mixed)
        rows.append((i, " ".join(mixed)))
    rows += [rows[3], rows[3], rows[7]]
    of = dict(rows)
    held = {i: {x.lower() for x in t.split() if "@" in x} for i, t in of.items()}
    terms = {i: {x.lower() for x in t.split() if "@" not in x} for i, t in of.items()}
    every = {i: {w for x in t.split() for w in re.findall(r"\w{2,}", x.lower())} for i, t in of.items()}
    n_t, n_e = Counter(w for x in every.values() for w in x), Counter(e for x in held.values() for e in x)
    n_et = Counter((e, w) for i in of for e in held[i] for w in terms[i])
    n = len(of)
    rule = {k for k, c in n_et.items() if n_e[k[0]] < n
            and log2(c * n / (n_e[k[0]] * max(n_t[k[1]], c))) / log2(n / n_e[k[0]]) >= pii.Policy().disclose - 1e-12}
    want = {}
    for i, t in of.items():
        want[i] = [m.span() for m in re.finditer(r"\S+", t) if "@" not in m[0] and any((e, m[0].lower()) in rule for e in held[i])]
    spans, text = found(spark, rows)
    assert rule and spans == want
    assert all("@" not in t and not any(f" {w} " in f" {t.lower()} " for e in held[i] for w in terms[i] if (e, w) in rule)
               for i, t in text.items())


def test_long_texts(spark):
    domain = "x" + ".y" * 1500
    many = " ".join(f"u{i}ser 10.{i % 200}.{i // 200 % 250}.7 é" for i in range(20_000))
    spans, text = found(spark, [(0, f"to a@{domain} now"), (1, many), (2, "plain text here")])
    base = {r.doc_id: r.base for r in pii.base_table(spark.createDataFrame(
        [(0, f"to a@{domain} now"), (1, many)], "doc_id long, text string")).collect()}
    assert [(x.s, x.e) for x in base[0]] == [(3, 5 + len(domain))]
    assert [(x.s, x.e) for x in base[1]] == [m.span() for m in re.finditer(r"10[.][0-9]+[.][0-9]+[.]7", many)]
    assert text[0].endswith("[EMAIL] ") or "[EMAIL]" in text[0]
    assert text[1].count("[IP]") == 20_000 and text[1].count("é") == 20_000 and text[2] == "plain text here"
