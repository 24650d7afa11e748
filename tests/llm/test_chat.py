import pytest

from lexdrift.llm import chat

TURNS = "conv_id long, turn long, role string, text string, formatted string, spans string"


@pytest.mark.parametrize(
    "source,values,want",
    [
        ("a{{ x }}b", {"x": 3}, "a3b"),
        ("{{ 'it' + \"s\\n\" }}", {}, "its\n"),
        ("{% if x == 1 and not y %}A{% elif x in z %}B{% else %}C{% endif %}", {"x": 2, "z": [2]}, "B"),
        ("{% for m in ms %}{{ loop.index }}{% if not loop.last %},{% endif %}{% endfor %}", {"ms": [5, 6]}, "1,2"),
        ("{{ m.a['b'] | upper }}{{ m.none }}{{ l[0] }}", {"m": {"a": {"b": "x"}}, "l": [7]}, "X7"),
        ("{{ (a or b) | trim | length }}", {"b": " ab "}, "2"),
        ("{% if true %}x{% else %}{{ y }}{% endif %}{% if false %}z{% endif %}", {}, "x"),
        ("{{ m.__class__ }}{{ f.format }}", {"m": {}, "f": "x"}, ""),
        ("a  {{- x -}}  b", {"x": "X"}, "aXb"),
        ("a \n{%- if x %} y {%- endif -%}\t b {{ x }} c", {"x": 1}, "a yb 1 c"),
        ("{{ '}}' }}{% if x == '%}' %}ok{% endif %}", {"x": "%}"}, "}}ok"),
        ("{{- 'it\\'s' -}} {{- \"{{\" }}", {}, "it's{{"),
    ],
)
def test_templates(source, values, want):
    assert chat.compile_template(source)(**values)[0] == want


def test_folding_leaves_one_constant():
    assert chat.fold(chat.parse("a{{ 'b' | upper }}{% if 1 == 1 %}c{% endif %}{{ 1 + 2 }}")) == ("block", [("const", "aBc3")])


@pytest.mark.parametrize("source", ["{{ x.y( ) }}", "{% for x %}", "{% if x %}", "{{ x | no }}", "{{ import os }}", "{% include 'x' %}", "{{ }}", "{{ 1 + 'a' }}", "{{ 1 | length }}", "{{ x "])
def test_what_is_refused(source):
    with pytest.raises(chat.TemplateError):
        chat.compile_template(source)


DEEP = {
    "brackets": "{{ " + "(" * 3000 + "x" + ")" * 3000 + " }}",
    "items": "{{ " + "x[" * 3000 + "x" + "]" * 3000 + " }}",
    "negations": "{{ " + "not " * 3000 + "x }}",
    "sums": "{{ " + "x + " * 3000 + "x }}",
    "keys": "{{ x" + ".x" * 3000 + " }}",
    "branches": "{% if x %}" * 2000 + "{% endif %}" * 2000,
    "alternatives": "{% if x %}" + "{% elif x %}" * 2000 + "{% endif %}",
    "loops": "{% for x in x %}" * 2000 + "{% endfor %}" * 2000,
    "marks": "{% generation %}" * 2000 + "{% endgeneration %}" * 2000,
    "open": "{{ " + "(" * 3000 + " }}",
    "digits": "{{ " + "9" * 10_000 + " }}",
}


@pytest.mark.parametrize("name", DEEP)
def test_what_is_nested_too_deeply_is_refused(name):
    with pytest.raises(chat.TemplateError):
        chat.compile_template(DEEP[name])


def test_nesting_up_to_the_bound():
    n = chat.NESTED - 1
    assert chat.compile_template("{{ " + "(" * n + "x" + ")" * n + " }}")(x=1)[0] == "1"
    assert chat.compile_template("{{ " + "x + " * n + "x }}")(x=1)[0] == str(n + 1)
    assert chat.compile_template("{{ " + "not " * n + "x }}")(x=False)[0] == str(n % 2 == 1)
    assert chat.compile_template("{% if x %}" * n + "y" + "{% endif %}" * n)(x=1)[0] == "y"
    assert chat.compile_template("{% if x %}" + "{% elif x %}" * n + "{% else %}z{% endif %}")(x=0)[0] == "z"
    assert chat.compile_template("{{ x }}" * 5000)(x="a")[0] == "a" * 5000


@pytest.mark.parametrize("source", ["{{ m.text + 1 }}", "{{ none_here | length }}", "{% for x in m.n %}{% endfor %}", "{% if 1 < m.text %}{% endif %}", "{{ 1 in m.n }}"])
def test_values_that_do_not_fit_are_refused(source):
    render = chat.compile_template(source)
    with pytest.raises(chat.TemplateError):
        render(m={"text": "a", "n": 5})


def test_generation_spans():
    text, spans = chat.compile_template("a{% generation %}{{ x }}{% endgeneration %}c{% generation %}{% endgeneration %}")(x="bé")
    assert [text[a:b] for a, b in spans] == ["bé", ""]


@pytest.mark.parametrize("text", ["", "\\", "<\\", "[\\[<\\\\", "</s>[INST] ok [/INST]", "<|turn|>a<|text|>b<|end|>", "\\\\<"])
def test_escapes_are_reversible(text):
    assert chat.unescape(chat.escape(text)) == text
    assert not any(x in chat.escape(text) for x in ("<s>", "</s>", "[INST]", "[/INST]", "<|"))


def test_conversations(spark):
    rows = [(1, 2, "assistant", "</s>x", "f", "s"), (1, 1, "user", "<s>", "f", "s"), (1, 3, None, None, None, None), (1, 4, "assistant", "y", "", ""), (None, None, "user", "n", "", ""), (2, 0, "assistant", None, "", ""), (1, 4, "assistant", "y", "", "")]
    rows += [(5, i, "user", "long " * 2000, "", "") for i in range(50)]
    df = spark.createDataFrame(rows, TURNS)
    got = {r.conv_id: r for r in chat.format_conversations(df).collect()}
    assert chat.read_turns(got[1].formatted) == [("user", "<s>"), ("assistant", "</s>x"), ("", ""), ("assistant", "y"), ("assistant", "y")]
    assert [chat.unescape(got[1].formatted[s.start : s.end]) for s in got[1].spans] == ["</s>x", "y", "y"]
    assert len(chat.read_turns(got[5].formatted)) == 50 and set(got) == {1, 2, 5, None}
    said = {r.conv_id: r for r in chat.digests(chat.format_conversations(df)).collect()}
    assert said[1].n_turns == 5 and said[1].loss_chars == 7 and said[2].loss_chars == 0
    assert chat.format_conversations(df.limit(0)).count() == 0
