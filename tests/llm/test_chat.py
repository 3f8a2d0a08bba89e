"""Templates: parsing, folding, the sandbox. Conversations: the formatted text, its mask, and an exact round trip."""

import hashlib
import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from colloquy.llm import chat, template
from colloquy.llm.template import For, Generation, If, Output, TemplateError, Text, compile_template, fold, parse


def _rendered(source, constants=None, **values):
    return "".join(text for text, _ in compile_template(source, values, constants)(**values))


@pytest.mark.parametrize("source, want", [
    ("a {{ x }}{# no #} b", "a 1 b"),
    ("{{ 'q' ~ x ~ \"'\" }}", "q1'"),
    ("{% if x == 1 and not y %}one{% elif y %}two{% else %}three{% endif %}", "two"),
    ("{% if x == 2 or y == none %}one{% else %}three{% endif %}", "three"),
    ("{% for m in ms %}{{ loop.index0 }}{{ m.a }}{% if not loop.last %},{% endif %}{% endfor %}", "0p,1q"),
    ("{% for m in ms %}{% for k in ms %}{{ k.a }}{% endfor %}{{ m['a'] | upper }}{% endfor %}", "pqPpqQ"),
    ("{{ 'a' in 'abc' }} {{ ('  b ' | trim) ~ none }}", "True b"),
    ("{% for m in ms %}{% if loop.first %}<{% endif %}{% endfor %}{{ ms[1].a }}", "<q"),
    ("", ""), ("}} %}", "}} %}"),
])
def test_rendering(source, want):
    assert _rendered(source, x=1, y="yes", ms=[{"a": "p"}, {"a": "q"}]) == want


def test_folding_leaves_what_depends_on_the_input():
    tree = fold(parse("a{{ 'b' ~ c }}{% if on and c == 'C' %}d{% generation %}e{% endgeneration %}{% else %}{{ x }}{% endif %}"
                      "{% if false %}{{ x }}{% endif %}{% if x and on %}f{{ '' }}{% endif %}"), {"c": "C", "on": True})
    x = template.Name("x")
    assert tree[:2] == (Text("abCd"), Generation((Text("e"),)))
    assert len(tree) == 3 and tree[2].then == (Text("f"),) and isinstance(tree[2], If) and tree[2].test.left == x
    # A loop's own names hide constants of the same name.
    loop, = fold(parse("{% for c in xs %}{{ c }}{{ loop.index }}{% endfor %}"), {"c": "C", "loop": 3})
    assert isinstance(loop, For) and loop.body[0] == Output(template.Name("c"))


@pytest.mark.parametrize("source", [
    "{{ x.__class__ }}", "{{ x | eval }}", "{{ x() }}", "{{ __import__ }}", "{{ other }}", "{% for %}{% endfor %}", "{% if x %}", "{{ }}",
    "{% endif %}", "{% import os %}", "{{ x.y", "{{ 1 + 1 }}", "{{ x y }}", "{% generation %}", "{{ " + "(" * 99 + "x" + ")" * 99 + " }}",
])
def test_the_sandbox_refuses(source):
    with pytest.raises(TemplateError):
        _rendered(source, x=1)


def test_values_out_of_reach():
    for source in ("{{ x.real }}", "{{ x['real'] }}", "{% for c in x %}{% endfor %}", "{{ d.missing }}", "{{ d.items }}", "{% for c in 'ab' %}{% endfor %}"):
        with pytest.raises(TemplateError):
            _rendered(source, x=1, d={"a": 1})


def test_a_loop_streams():
    read = []

    def endless():
        for i in range(10**9):
            read.append(i)
            yield {"role": "user", "text": str(i)}

    pieces = compile_template(chat.TEMPLATE, {"messages"}, chat.CONSTANTS)(messages=endless())
    for _ in range(50):
        next(pieces)
    assert len(read) < 20


AWKWARD = st.text(alphabet=st.sampled_from(list("\\#</turn>: \nab\u00e9\U0001f600")), max_size=30)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(AWKWARD, AWKWARD), max_size=6), st.integers(1, 40))
def test_round_trip(turns, size):
    messages = [{"role": role, "text": text} for role, text in turns]
    made = list(chat.segments(compile_template(chat.TEMPLATE, {"messages"}, chat.CONSTANTS)(messages=messages), size))
    assert list(chat.read_turns(text for text, _ in made)) == turns
    masked = "".join(template.unescape(text[m["start"]:m["stop"]]) for text, mask in made for m in mask)
    assert masked == "".join(text for role, text in turns if role == "assistant")


def test_cut_text_is_an_error():
    with pytest.raises(ValueError):
        list(chat.read_turns(["### user: half"]))


def _brute(rows):
    conversations = defaultdict(list)
    for conv, turn, role, text in rows:
        conversations[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = set()
    for conv, turns in conversations.items():
        turns.sort()
        whole = "".join(f"{role}\n{text}\n" for *_, role, text in turns)
        loss = "".join(text for *_, role, text in turns if role == "assistant")
        size = sum(14 + len(template.escape_name(role)) + len(template.escape(text)) for *_, role, text in turns)
        out.add((conv, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), size))
    return out


def test_conversations(spark):
    rng = random.Random(3)
    bits = ["</turn>", "\\", "###", ": ", "\n", "word", "\u00e9", "\U0001f600", "### assistant: "]
    rows = [
        (rng.randrange(40), rng.choice([0, 1, 2, 3, None]), rng.choice(["user", "assistant", "system", "odd: \\ role", None]),
         rng.choice([None, "", "".join(rng.choices(bits, k=6))]))
        for _ in range(600)
    ]
    rows += [(None, 0, "user", "no id"), (None, 1, "assistant", "none"), (50, 0, "assistant", "same"), (50, 0, "assistant", "same")]
    rows += [(51, i, "assistant", "x \\" * 9_000) for i in range(30)] + [(52, 0, "assistant", "###" * 300_000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns(
        {"segment": F.lit("x"), "formatted": F.lit(1), "mask": F.lit(None).cast("int")}
    )
    formatted = chat.format_conversations(turns)
    got = [tuple(r) for r in chat.digest_formatted(formatted, ordered=True).collect()]
    assert len(got) == len(set(got)) and set(got) == _brute(rows)
    assert formatted.where("conv_id = 51").count() > 1 and formatted.where("conv_id = 3").count() == 1
    shuffled = formatted.orderBy(F.rand(1))
    assert {tuple(r) for r in chat.digest_formatted(shuffled).collect()} == set(got)


def test_no_conversation(spark):
    turns = spark.createDataFrame([], "conv_id string, turn int, role string, text string")
    assert chat.digest_formatted(chat.format_conversations(turns)).count() == 0


def test_another_template(spark):
    turns = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "bot", "yo")], "conv_id long, turn long, role string, text string")
    source = "{% if bos %}<s>{% endif %}{% for m in messages %}{% if m.role == bot %}{% generation %}{{ m.text }}{% if loop.last %}</s>{% endif %}" \
             "{% endgeneration %}{% else %}[{{ m.text }}]{% endif %}{% endfor %}"
    row, = chat.format_conversations(turns, source, {"bos": True, "bot": "bot"}).collect()
    assert (row.formatted, [tuple(m) for m in row["mask"]]) == ("<s>[hi]yo</s>", [(7, 13)])
