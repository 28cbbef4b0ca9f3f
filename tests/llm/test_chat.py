"""The template language, and conversations that are formatted and read back."""

import hashlib
import random

import pytest

from ticketflow.llm import chat
from ticketflow.llm.template import BEGIN, END, Template, TemplateError, fold, parse

from .helpers import collected


def text(source, **scope):
    return "".join(p for p in Template(source).render(**scope) if isinstance(p, str))


@pytest.mark.parametrize("source, scope, wanted", [
    ("a{{ 'b' }}c", {}, "abc"), ("{{ x }}|{{ y }}", {"x": 1}, "1|"), ("{{ a.b['c'][1] }}", {"a": {"b": {"c": [1, 2]}}}, "2"),
    ("{% if x == 1 %}one{% elif x > 1 %}more{% else %}none{% endif %}", {"x": 2}, "more"),
    ("{% for i in xs %}{{ loop.index }}{{ i }}{% if not loop.last %},{% endif %}{% endfor %}", {"xs": "ab"}, "1a,2b"),
    ("a  {%- if true -%}  b  {%- endif %} c", {}, "ab c"), ("{# no #}x{{ 'it\\'s\\n' }}", {}, "xit's\n"),
    ("{% set y = x + 1 %}{{ y ~ '!' }}", {"x": 4}, "5!"), ("{{ 'b' in 'abc' and not ('z' in 'abc') }}", {}, "True"),
    ("{{ x not in 'abc' or false }}", {"x": "a"}, "False"), ("{{ '  Ab ' | trim | upper }}{{ 'abc' | length }}", {}, "AB3"),
    ("{{ x.__class__ }}{{ x.upper }}{{ -1 }}", {"x": "s"}, "-1"), ("{% for i in none %}x{% endfor %}", {}, "")])
def test_language(source, scope, wanted):
    assert text(source, **scope) == wanted


@pytest.mark.parametrize("source", ["{% if x %}", "{% endif %}", "{{ }}", "{{ f(1) }}", "{{ x | eval }}", "{% import os %}",
                                    "{{ 'a' 'b' }}", "{{ a. }}", "{% else %}", "{{ $ }}"])
def test_what_is_no_template(source):
    with pytest.raises(TemplateError):
        Template(source)


def test_constants_are_folded():
    assert fold(parse("a{{ 'b' ~ (1 + 1) }}{% if 1 > 2 %}x{% elif true %}y{% endif %}z")) == ("block", [("text", "ab2yz")])
    assert fold(parse("{% if false %}x{% endif %}")) == ("block", [])


def test_marks():
    out = list(Template("a{% generation %}b{% endgeneration %}").render())
    assert out == ["a", BEGIN, "b", END]


def expected(rows):
    by = {}
    for conv, turn, role, t in rows:
        by.setdefault(conv, []).append(((turn is not None, turn or 0), role or "", t or ""))
    out = []
    for conv, turns in by.items():
        turns.sort()
        learned = "".join(t for _, r, t in turns if r == "assistant")
        out.append((conv, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest(),
                    len(learned), hashlib.sha256(learned.encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[0] is not None, r[0]))


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, part string, spans int")
    return df, chat.format_conversations(df, **options)


def test_odd_conversations(spark):
    rng = random.Random(5)
    bits = ["\\", "###", "### ", "</turn>", "</tur", "n>", "\n", "user", "<", "é🙂", "\\\\", ":", " ", "### assistant\n", ""]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "a\nb", "### x", "</turn>", "\\", None]),
             rng.choice([None, "".join(rng.choice(bits) for _ in range(rng.randrange(12)))]))
            for c in [None, *range(60)] for t in range(rng.randrange(1, 6))]
    rows += [(1, None, "user", "first"), (1, 0, "user", "tie"), (1, 0, "user", "tie"), (70, 0, "assistant", "long " * 60_000)]
    rows += [(71, i, "assistant" if i % 2 else "user", f"turn {i} \\") for i in range(3000)]
    _, formatted = run(spark, rows, part=20_000)
    assert formatted.where("part > 3").count() > 0
    assert [r[:5] for r in collected(chat.read_back(formatted), "conv_id")] == expected(rows)


def test_no_rows_and_other_template(spark):
    _, none = run(spark, [])
    assert chat.read_back(none).count() == 0
    source = "{{ messages[0].role }}:{% for m in messages %}{% generation %}{{ m.text }}{% endgeneration %};{% endfor %}"
    _, out = run(spark, [(1, 0, "user", "ab"), (1, 1, "x", "c")], template=source)
    row = out.first()
    assert row["formatted"] == "user:ab;c;" and [tuple(s) for s in row["spans"]] == [(5, 7), (8, 9)] and row["n_turns"] == 2


def test_text_that_is_no_conversation(spark):
    with pytest.raises(Exception, match="read back"):
        chat.read_back(spark.createDataFrame([(1, 0, "plain", 1, [])], chat.PARTS)).collect()
