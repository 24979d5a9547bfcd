import hashlib
import random

import pytest

from ledgerscope.llm import chat as c
from ledgerscope.llm import template as t
from ledgerscope.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def render(source, **values):
    return "".join(x for x, _ in t.compile_template(source, {"up": lambda v: str(v).upper()})(**values))


@pytest.mark.parametrize(
    "source, want",
    [
        ("a{{ 'b' + 'c' }}", "abc"),
        ("{% for x in xs %}{{ loop.index0 }}{{ x.k }}{% if not loop.last %},{% endif %}{% endfor %}", "0p,1q"),
        ("{% if n > 2 and not n == 4 %}y{% elif n == 4 %}f{% else %}n{% endif %}", "y"),
        ("{% set z = n + 1 %}{{ z }}{{ none }}", "4"),
        ("{{ 'yes' if 'p' in w else 'no' }}|{{ w | up }}|{{ xs_none }}", "yes|SPAM|"),
        ("{{ w['x'] if false else \"q\\n\" }}", "q\n"),
    ],
)
def test_template(source, want):
    assert render(source, xs=[{"k": "p"}, {"k": "q"}], n=3, w="spam", xs_none=None) == want


def test_folding_and_sandbox():
    assert t.fold(t.parse("a{% if 1 == 1 %}b{% else %}{{ x }}{% endif %}{{ 2 + 3 }}"), {}) == ("block", [("text", "ab5")])
    for bad in ["{{ x.__class__ }}", "{{ y }}", "{{ x | nope }}", "{% if 1 %}", "{% evil %}", "{{ f() }}", "{{ 1 + 'a' }}", "{{ }}"]:
        with pytest.raises(t.TemplateError):
            render(bad, x=3)


def test_escape_round_trip():
    rng = random.Random(1)
    parts = [*c.MARKS, c.ESCAPE, "<", "|", ">", "[", "/", "INST]", "s", "é"]
    for _ in range(3_000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 9)))
        shown = c.escape(text)
        assert c.unescape(shown) == text
        assert not any(m in shown for m in c.MARKS)


def plain(rows):
    """Figures straight from the rows."""
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn is not None, turn, role is not None, role, text is not None, text))
    out = {}
    for conv, turns in by.items():
        turns = sorted(turns, key=lambda x: tuple((v is not None, v) if not isinstance(v, bool) else v for v in x))
        said = [(r or "", x or "") for *_, _, r, _, x in turns]
        loss = "".join(x for r, x in said if r == "assistant")
        out[conv] = (len(said), sha("".join(f"{r}\n{x}\n" for r, x in said)), len(loss), sha(loss))
    return out


def check(got, rows):
    want = plain(rows)
    assert len(got) == len(want)
    for r in got:
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == want[r.conv_id]
        assert r.formatted_chars > r.loss_chars


def test_odd_rows(spark):
    rows = [
        (1, 0, "user", None), (1, 1, "assistant", "</s>[INST]<|user|>"), (1, 1, "assistant", "</s>[INST]<|user|>"),
        (2, None, None, "x"), (2, 0, "odd|>role", "y\n"), (None, 0, "system", "s<<SYS>>"), (3, 5, "assistant", ""),
        (4, 0, "assistant", "é" * 300_000), (5, 0, "user", "a\x10"), (5, 0, "user", "\x10<s>"),
    ]
    table = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, n_turns int")
    check(c.digests(table).collect(), rows)
    shown = {r.conv_id: r for r in c.format_conversations(table).collect()}
    a, b = shown[4].loss_spans
    assert shown[4].formatted[a:b] == "é" * 300_000
    assert c.digests(table.filter("false")).count() == 0
    assert [r.conv_id for r in c.digests(c.with_probe(table.filter("false"))).collect()] == [-7]


def test_query(spark):
    table = spark.read.parquet(f"{SF}/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    said = "</s>[INST] ok [/INST]"
    check(QUERIES["op3_chat_format"][0](spark, SF).collect(), [*rows, (-7, 0, "user", said), (-7, 1, "assistant", said)])
