import re

import pytest

from ticketflow.llm import licenses as L

from .helpers import collected, documents, saved

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def places(text):
    """``(start, label)`` of every phrase, by comparing words at every place."""
    words = WORD.findall((text or "").translate(LOWER))
    return len(words), [(i, label) for label, phrase in L.PHRASES for i in range(len(words))
                        if words[i:i + len(phrase.split())] == phrase.split()]


def check_base(rows, out):
    got = {r.doc_id: r for r in out}
    for i, text in rows:
        n, found = places(text)
        r, starts = got[i], [s for s, _ in found]
        assert (r.n_words, r.n_base) == (n, len(found))
        assert (r.first_word, r.last_word) == ((min(starts), max(starts)) if starts else (None, None))
        assert r.base_labels == ",".join(sorted({label for _, label in found}))
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and (r.score == 1.0 or not found)


def test_query_against_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check_base(rows, L.op12(spark, sf).collect())


def test_phrases_at_every_edge(spark):
    rows = list(enumerate([
        "Under the MIT License", "under the MIT\n\nLicense under-the mit_license!", "under the mit licenses", "sunder the mit license",
        "CC BY NC CC by nc by nc", "Apache License, Version 2.0", "apache license version 20", "éunder the mit license", "under  theé mit license",
        "UNDER THE MİT LICENSE", "under the mit license under the mit license", None, "", " ... ", "mit", "Apache Kicense", "a " * 40_000 + "cc by nc"]))
    docs = documents(spark, rows)
    out = L.scan(docs)[0].collect()
    assert len(out) == len(rows)
    check_base(rows, out)


@pytest.mark.parametrize("change,label", [
    (lambda w: w, "isc"), (lambda w: w[:10] + ["really"] + w[10:], "isc"), (lambda w: w[:8] + w[9:], "isc"),
    (lambda w: w[:12] + ["x"] + w[13:], "isc"), (lambda w: w[:len(w) // 2], ""), (lambda w: w[::-1], ""),
    (lambda w: [x for y in w for x in (y, "z")], "")])
def test_edited_notices(spark, change, label):
    notice = dict(L.NOTICES)["isc"].split()
    text = "before it " + " ".join(change(notice)) + " and after"
    rows, spans = L.scan(documents(spark, [text]))
    [row] = rows.collect()
    assert row.labels == label and row.n_base == 0 and (row.score >= L.COVER) == bool(label)
    for s in spans.collect():
        assert s.first == 2 and s.last == 1 + len(change(notice)) and s.label == label


def test_the_longest_of_overlapping_notices(spark):
    text = dict(L.NOTICES)
    rows, _ = L.scan(documents(spark, [text["cc-by-sa"], text["cc-by"], f"{text['cc-by']}. {text['gpl-3']}. {text['mit']}",
                                       "This work is licensed under the GNU General Public License, version 3."]))
    assert [r.labels for r in rows.orderBy("doc_id").collect()] == ["cc-by-sa", "cc-by", "cc-by,gpl-3,mit", "gpl-3"]


def test_notices_longer_than_a_template(spark):
    words = [f"word{i}" for i in range(150)]
    given = [("long", " ".join(words))]
    assert [len(p[3]) for p in L.parts((), given)] == [50, 50, 50]
    rows, spans = L.scan(documents(spark, ["x " + " ".join(words), " ".join(words[60:80])]), (), given)
    assert [r.labels for r in rows.orderBy("doc_id").collect()] == ["long", ""] and spans.count() == 3
    for bad in ([("a,b", "x y z")], [("a", "x y")], [("a", "X y z")]):
        with pytest.raises(ValueError):
            L.parts((), bad)


def test_repeated_rows_null_ids_and_no_rows(spark):
    docs = documents(spark, [(7, "cc by nc"), (7, "cc by nc"), (7, "plain"), (None, "cc by nc"), (None, None)])
    got = collected(L.scan(docs)[0].select("doc_id", "n_base", "labels"), "doc_id", "n_base")
    assert got == [(None, 0, ""), (None, 1, "cc-by-nc"), (7, 0, ""), (7, 1, "cc-by-nc"), (7, 1, "cc-by-nc")]
    assert L.scan(documents(spark, []))[0].collect() == []


def test_no_python_in_the_plan(spark, sf, tmp_path):
    rows, spans = L.scan(spark.read.parquet(saved(spark, documents(spark, ["cc by nc"]), tmp_path, "documents") + "/documents.parquet"))
    for df in (rows, spans):
        plan = df._jdf.queryExecution().toString()
        assert "Python" not in plan and "MapIn" not in plan and "Cartesian" not in plan
