"""The pipeline's stages, each on what the one before kept."""

import re
import zlib

import numpy as np
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from ticketflow.llm import simhash
from ticketflow.llm.common import table
from ticketflow.llm.tokens import vocabulary

from .helpers import documents, groups
from .test_likeness import plain
from .test_suffixes import brute


def stages(spark, docs, sf):
    out = [docs]
    for _, step in corpus_pipeline.STAGES:
        out.append(step(spark, out[-1], sf))
    return out


def test_every_stage_on_a_table(spark, sf):
    given, good, single, cut, hidden, packed = (d.collect() for d in stages(spark, table(spark, sf, "documents"), sf))
    columns = given[0].asDict().keys()
    assert all(r.asDict().keys() == columns for rows in (good, single, cut, hidden) for r in rows)
    by = {r["doc_id"]: r for r in given}
    assert good and all(by[r["doc_id"]] == r for r in good)
    sets = {r["doc_id"]: plain(r["text"]) for r in good}
    ids = sorted(sets)
    roots = groups([(a, b) for a in ids for b in ids if a < b and (sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) > 0)], ids)
    assert sorted(r["doc_id"] for r in single) == sorted(set(roots.values()))
    wanted = {i: kept for i, kept, spans in brute([(r["doc_id"], r["text"]) for r in single], 50)}
    for r in cut:
        assert len(r["text"].encode()) >= len(wanted[r["doc_id"]]) and r["n_chars"] == len(r["text"])
    assert sorted(r["doc_id"] for r in cut) == sorted(wanted) == sorted(r["doc_id"] for r in hidden)
    assert not any(re.search(r"[\w.]+@[\w-]+\.\w+", r["text"]) for r in hidden)
    check_packed(packed, {r["doc_id"]: r["text"] for r in hidden})


def check_packed(rows, texts):
    tokenizer = Tokenizer.from_file(vocabulary())
    tokenizer.encode_special_tokens = True
    places = {}
    for r in rows:
        ids = [*tokenizer.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids, 2][r["start"]:r["start"] + r["length"]]
        assert zlib.crc32(np.array(ids, "<u4").tobytes()) == r["ids_crc32"]
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert {r["doc_id"] for r in rows} == set(texts)
    for parts in places.values():
        assert [o for o, _ in sorted(parts)] == list(np.cumsum([0, *[n for _, n in sorted(parts)]])[:-1])


def test_odd_documents(spark, sf):
    text = "One clean text with several ordinary words in it, long enough to be cut where it comes again."
    front = "Entirely new words stand in front of what then follows here. "
    docs = documents(spark, [(1, text), (1, text), (2, front + text), (4, "New words. " + text), (7, "odd " + "x" * 60), (3, None), (None, None), (5, ""), (6, "a@b.cc é"), (None, text)])
    outs = [d.collect() for d in stages(spark, docs, sf)]
    assert len(outs[1]) == len(outs[0]) and len(outs[2]) == 5 and all(len(o) == 5 for o in outs[3:])
    assert {r["doc_id"] for r in outs[2]} == {1, 2, 3, 6, 7}  # 4 shares 14 of 16 runs with 1
    assert {r["doc_id"]: r["text"] for r in outs[4]} == {1: text, 2: front, 3: None, 6: "[EMAIL] é", 7: "odd " + "x" * 60}
    assert all(d.count() == 0 for d in stages(spark, documents(spark, []), sf))


def test_run_is_registered_and_applies_all_stages(spark, sf):
    rows = entry.queries()["pipeline"](spark, sf).collect()
    assert {"doc_id", "piece", "sequence_id", "offset"} <= rows[0].asDict().keys()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeated_passages", "personal_data", "packing"]


def test_one_row_of_each_group_stays(spark):
    docs = documents(spark, [(None, "same text here"), (4, "same text here"), (3, "same text here"), (3, "same text here"), (None, "alone it is")])
    assert sorted(map(str, (r["doc_id"] for r in simhash.first_of_groups(docs).collect()))) == ["3", "None"]


def test_near_copies_of_operator_8_go_too(spark, sf):
    """Fingerprints follow what is repeated, likeness the distinct runs: these two are near copies to operator 8 only."""
    often = "one two three " * 100
    texts = [often + " ".join(f"{w}{i}" for i in range(30)) for w in ("left", "right")]
    assert bin(simhash.fingerprint(texts[0]) ^ simhash.fingerprint(texts[1])).count("1") <= 2
    docs = documents(spark, [(5, texts[0]), (3, texts[1]), (9, "another text altogether, with words of its own")])
    assert sorted(r["doc_id"] for r in corpus_pipeline.keep_first_of_near_copies(spark, docs, sf).collect()) == [3, 9]
