"""Spans against plain patterns, and disclosing terms against counts by hand."""

import hashlib
import math
import random
import re

from ticketflow.llm import privacy
from ticketflow.llm.common import table

from .helpers import collected, documents

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            doubled = [int(d) * 2 if i % 2 else int(d) for i, d in enumerate(digits[::-1])]
            if (kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split("."))
                    or kind == "card" and 14 <= len(digits) <= 19 and sum(n // 10 + n % 10 for n in doubled) % 10 == 0
                    or kind == "phone" and 10 <= len(digits) <= 15):
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_spans_as_by_plain_patterns():
    rng = random.Random(2)
    bits = ["a@b.c", "@", ".", "-", "1", "12", "255", "256", "+1", "+4915112345678", "4041894974608795", " ", "é", "x", "0012",
            "1.2.3.4", "(", ")", "a@", "b.c", "%", "_", "4111-1111-1111-1111", "٣"]
    for _ in range(6000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(14)))
        assert privacy.base_spans(text) == plain_spans(text), text


def test_long_runs_take_no_long_time():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "a@" * 150_000, "+1" + "(" * 300_000, "1 " * 150_000, "a@" + "b-" * 150_000):
        privacy.base_spans(text)
    assert privacy.base_spans("1." * 5 + "9" * 5000) == [(0, 1, 7)]


def disclosing(texts, support=3, least=0.85):
    """(document, start, end) of disclosing words, by counting sets of documents."""
    spans = [privacy.base_spans(t) for t in texts]
    near = [privacy.surroundings(t, s) for t, s in zip(texts, spans)]
    words = [{privacy.term(w) for w in privacy.TERM.findall(t.lower())} for t in texts]
    out, n = set(), len(texts)
    for i, rows in enumerate(near):
        for c, _, t, a, b in rows:
            both = {j for j, other in enumerate(near) if any(x[0] == c and x[2] == t for x in other)}
            places = {x[1] for other in near for x in other if x[0] == c and x[2] == t}
            has_c = {j for j, other in enumerate(near) if any(x[0] == c for x in other)}
            has_t = sum(t in w for w in words)
            if len(places) >= support and len(has_c) < n:
                ratio = math.log(len(both) * n / (len(has_c) * has_t)) / math.log(n / len(has_c))
                if ratio >= least - 1e-12:
                    out.add((i, a, b))
    return out


def corpus():
    rng = random.Random(4)
    names = ["zanders", "quillon"]
    words = ["alpha", "bravo", "charlie", "delta", "echoes", "foxtrot", "golfing", "hotel"]
    texts = [" ".join(rng.choices(words, k=30)) for _ in range(60)]
    for i in range(8):
        texts[i] += f" {names[i % 2]} wrote from {names[i % 2]}@mail.example.com about {rng.choice(words)} number {i}"
    texts += ["mrrare once wrote rare@mail.example.com today"] + ["copied zorgon a@b.cc again"] * 5
    return texts + [None, "", "zanders@mail.example.com"]


def test_disclosing_terms(spark):
    texts = corpus()
    rows = privacy.private_spans(documents(spark, texts)).collect()
    found = {(r["doc_id"], s["a"], s["b"]) for r in rows for s in r["terms"]}
    assert found == disclosing([t or "" for t in texts])
    said = {texts[i][a:b] for i, a, b in found}
    assert said & {"zanders", "quillon"} and not said & {"alpha", "mrrare", "zorgon", "copied"}


def test_sanitised_text(spark):
    docs = documents(spark, corpus())
    out = privacy.sanitise(docs)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    rows = {r["doc_id"]: r for r in out.collect()}
    assert "[EMAIL]" in rows[0]["text"] and "@" not in rows[0]["text"] and "zanders" not in rows[0]["text"]
    assert rows[len(corpus()) - 3]["text"] is None and all(r["n_chars"] == len(r["text"]) for r in rows.values() if r["text"])
    assert rows[20]["text"] == corpus()[20] and len(rows) == len(corpus())


def test_query_on_a_table(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").collect()}
    rows = privacy.op7(spark, sf).collect()
    assert {r["doc_id"] for r in rows} == set(texts)
    for r in rows:
        spans = plain_spans(texts[r["doc_id"]])
        named = [f"{list(PLAIN)[k]}:{a}:{b}" for a, k, b in spans]
        assert r["base_sha256"] == hashlib.sha256(",".join(named).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in PLAIN] == [sum(s[1] == i for s in spans) for i in range(4)]
        assert [s for s in r["spans"].split(",") if s and not s.startswith("term")] == named
    assert sum(len(plain_spans(t)) for t in texts.values()) > 0


def test_no_rows_and_repeated_ids(spark):
    assert privacy.private_spans(documents(spark, [])).count() == 0
    assert privacy.sanitise(documents(spark, [])).count() == 0
    rows = collected(privacy.private_spans(documents(spark, [(1, "a@b.cc"), (1, "a@b.cc"), (None, "1.2.3.4")])).drop("_row"), "doc_id")
    assert [(r[0], len(r[1])) for r in rows] == [(None, 1), (1, 1), (1, 1)]


def test_disclosing_terms_anywhere(spark):
    filler = " ".join(f"{w} plain words" for w in ["alpha", "bravo", "charlie", "delta"] * 20)
    texts = [f"{filler} number {chr(97 + i)}{i % 7}" for i in range(60)]
    for i in range(5):  # the name stands by the address and at the end, the project at the end only
        texts[i] = f"{chr(113 + i) * 5} Zanders zan@mail.example.com {chr(113 + i) * 6} {filler} moonshot yours zanders"
    texts[9] += " seen by Zanders"
    rows = {r["doc_id"]: r for r in privacy.private_spans(documents(spark, texts)).collect()}
    found = {(i, texts[i][s["a"]:s["b"]]) for i, r in rows.items() for s in r["terms"]}
    assert {(i, w) for i, w in found if w in ("Zanders", "zanders", "moonshot")} == (
        {(i, w) for i in range(5) for w in ("Zanders", "zanders", "moonshot")} | {(9, "Zanders")})
    assert not {w for _, w in found} & {"alpha", "plain", "words"}
    assert texts[0].index("moonshot") > 500
    clean = {r["doc_id"]: r["text"] for r in privacy.sanitise(documents(spark, texts)).collect()}
    assert not any("anders" in t or "moonshot" in t for t in clean.values())


def test_short_names_and_identifiers_are_terms(spark):
    texts = [f"plain text of some words number {i} and no more" for i in range(60)]
    for i in range(5):
        texts[i] = f"{chr(97 + i) * 4} Lee 李明 EMP4711 wrote from zan@mail.example.com of some words number {i} {chr(97 + i) * 5}"
    rows = privacy.private_spans(documents(spark, texts)).collect()
    found = {(r["doc_id"], texts[r["doc_id"]][s["a"]:s["b"]]) for r in rows for s in r["terms"]}
    assert found >= {(i, w) for i in range(5) for w in ("Lee", "李明", "EMP4711")}
    assert not {w for _, w in found} & {"of", "some", "words", "number", "0", "1"}
