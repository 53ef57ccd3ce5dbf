"""Round trips of formatted conversations, and the template language."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftql.llm import chat


def render(source, messages):
    return "".join(t for t, _ in chat.compile_template(source)(messages))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a:b", "\\", "### x: "]), st.text(alphabet="ab\\#</turn>: \n#é", max_size=30)), max_size=5))
def test_round_trip(turns):
    messages = [{"role": r, "text": t} for r, t in turns]
    pieces = list(chat.compile_template(chat.TEMPLATE)(messages))
    formatted = "".join(t for t, _ in pieces)
    assert [(r, t) for r, t, _, _ in chat.turns_of(formatted)] == turns
    assert [chat.unescape(t) for t, marked in pieces if marked and t] == [t for r, t in turns if r == "assistant" and t]


def test_language():
    assert render("{% for m in messages %}{{ loop.index }}{% if loop.last %}.{% elif m.role == 'x' %}!{% else %},{% endif %}{% endfor %}", [{"role": "a"}, {"role": "x"}, {"role": "b"}]) == "1,2!3."
    assert render("{# note #}{{ 'a' + 'b' | upper }}{{ none }}{{ (1 == 1) and 'yes' }}{{ 'x' in 'xyz' }}", []) == "aByesTrue"
    assert render("{{ messages | length }}", [1, 2]) == str(len("[1, 2]"))
    assert chat.fold(chat.parse("a{{ 'b' ~ 1 }}{% if false %}c{% else %}d{% endif %}")) == ("const", "ab1d")
    assert chat.fold(chat.parse("{% if true or x %}{{ y }}{% endif %}"))[0] in ("if", "out")


@pytest.mark.parametrize("bad", ["{% for x %}{% endfor %}", "{% if a %}", "{{ a.b( }}", "{{ a | nope }}", "{% exec x %}", "{{ ().__class__ }}", "{{ a b }}", "x" * 70_000, "{{ " + "(" * 60 + "1" + ")" * 60 + " }}"])
def test_rejected(bad):
    with pytest.raises(chat.TemplateError):
        chat.compile_template(bad)


def test_no_way_to_attributes():
    assert render("{{ 'a'.upper }}{{ messages.__class__ }}", []) == ""


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(rows):
    out = set()
    for conv in {r[0] for r in rows}:
        turns = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: tuple((x is not None, x) for x in r))
        turns = [(r or "", t or "") for _, r, t in turns]
        loss = "".join(t for r, t in turns if r == "assistant")
        out.add((conv, len(turns), digest("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), digest(loss)))
    return out


def test_table(spark):
    rng = random.Random(2)
    rows = [(i // 5, i % 5, rng.choice(["user", "assistant", None]), rng.choice(["", None, "plain", "a</turn>\n### b: c\\", "é" * 50])) for i in range(200)]
    rows += [(None, 0, "user", "x"), (None, None, "assistant", "y"), (1, 0, "user", "again"), (1, 0, "user", "again"), (-3, 1, "assistant", "z" * 100_000)]
    df = spark.createDataFrame([(*r, "junk", 1) for r in rows], "conv_id long, turn long, role string, text string, part string, formatted int")
    for part_chars in (1 << 20, 40):  # in one part, and in a part a turn
        out = chat.read_back(chat.format_conversations(df, part_chars=part_chars)).collect()
        assert {tuple(r)[:5] for r in out} == brute(rows) and len(out) == len(brute(rows))
    parts = chat.format_conversations(df, part_chars=40).where("conv_id = 1").collect()
    assert len(parts) > 1
    assert chat.read_back(chat.format_conversations(df.limit(0))).collect() == []
    probe = chat.read_back(chat.format_conversations(chat.with_probe(df.limit(0)))).collect()
    said = r"\### Assistant: </turn> ok"
    assert [tuple(r)[:5] for r in probe] == [(-7, 2, digest(f"user\n{said}\nassistant\n{said}\n"), len(said), digest(said))]
