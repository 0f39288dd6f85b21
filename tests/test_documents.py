"""Golden results for trees, selectors, Markdown and MDX."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.functions import ipa
from quire.html.convert import Converter, code_span, pipe_table
from quire.html.select import compile_selector, first, select
from quire.html.tree import parse
from quire.markdown import adapters, fences, mdx, transform
from quire.operators.derive import retrying
from quire.sources import files

LINES = st.lists(st.sampled_from(["```", "~~~~", "````py", "> ```", "  text", "# head", "", "    code", "``` x"]), max_size=12)


@given(LINES)
@settings(max_examples=200, deadline=None)
def test_segments_join_to_the_text(lines):
    text = "\n".join(lines)
    assert "\n".join(part for _, part in fences.segments(text)) == text
    assert fences.map_prose(text, lambda p: p) == text


@given(st.lists(st.tuples(st.integers(0, 30), st.integers(1, 9)), max_size=8))
@settings(deadline=None)
def test_edits_apply_from_the_end(spans):
    text, at, edits = "x" * 60, 0, []
    for a, n in sorted(spans):
        if a >= at:
            edits.append((a, a + n, "<>"))
            at = a + n
    out = transform.apply_edits(text, edits)
    assert out.count("<>") == len(edits) and len(out) == 60 - sum(b - a - 2 for a, b, _ in edits)


def test_fences():
    text = "a\n> ```js\n> b\n> ```\nc\n````\n```\nd\n````\ne\n~~~\nopen"
    assert [k for k, _ in fences.segments(text)] == ["prose", "code", "prose", "code", "prose", "code"]
    assert [c for _, c in fences.toggled_states(["```", "x", "~~~", "y"])] == [True, True, True, False]
    assert [c for _, c in fences.column_states([" ```", "x"])] == [False, False]
    assert [c for _, c in fences.quoted_states(["> ```", "> x", "> ``` end", "y"])] == [True, True, True, False]


def test_selectors():
    root = parse("<div id=a class='x y'><p><a href='/docs/b' data-k='v w'>1</a></p><a href='c'>2</a></div><p>3")
    assert [n.text() for n in select(root, "div#a.x > a, p a[href^='/docs']")] == ["1", "2"]
    assert [n.text() for n in select(root, "div a")] == ["1", "2"] and first(root, "[data-k~='w']").text() == "1"
    assert [n.text() for n in select(root, "[href$='c'], [href*=ocs]")] == ["1", "2"]
    for bad in ("p:contains(x)", "", "p >", "a,,b"):
        with pytest.raises(ValueError):
            compile_selector(bad)


@pytest.mark.parametrize(
    ("html", "markdown"),
    [
        ("<h2>A <em>b</em></h2><p>one<p>two", "## A *b*\n\none\n\ntwo"),
        ("<p><strong> x </strong>y <del>z</del> <b></b></p>", "**x** y ~~z~~"),
        ("<ul><li>a<li>b<ol><li>c</ol></ul>", "- a\n- b\n  1. c"),
        ("<pre><code class='lang-py'>a\n  b\n</code></pre>", "```py\na\n  b\n```"),
        ("<p>a<br>b <kbd>x`y</kbd></p>", "a  \nb ``x`y``"),
        ("<blockquote><p>q</p><p>r</p></blockquote>", "> q\n>\n> r"),
        ("<p>t</p><script>var x = '</p>'</script><style>p{}</style>", "t"),
        ("<figure><img src='/i.png' alt='I'><figcaption>cap</figcaption></figure>", "![I](/i.png)\n\ncap"),
        ("<p>1. a*b_c [x] `y` \\ z</p><p># no</p><p>- no</p><p>a - b # c 1. d</p>", "1\\. a\\*b\\_c \\[x\\] \\`y\\` \\\\ z\n\n\\# no\n\n\\- no\n\na - b # c 1. d"),
        ("<p>&gt; q</p><p>== r</p><pre><code>a*b</code></pre><p><code>x_y</code></p>", "\\> q\n\n\\== r\n\n```\na*b\n```\n\n`x_y`"),
        ("<svg><title>T</title><text>12 %</text><text>word</text></svg>", "T | word"),
    ],
)
def test_conversion(html, markdown):
    assert Converter().convert(html) == markdown


def test_tables():
    html = "<table><tr><th></th><th>K</th></tr><tr><td><kbd>a|b</kbd></td></tr><tr></tr><tr><td>x<br>y</td><td><a href='u'>l</a></td></tr></table>"
    assert pipe_table(parse(html)) == "|   | K |\n| --- | --- |\n| `a\\|b` |   |\n| x<br>y | [l](u) |"
    assert transform.table_row("| a \\| b | `c | d` | |") == ["a \\| b", "`c | d`", ""]
    assert code_span("``") == "``` `` ```"
    rules = {"mark": lambda node, inner: f"=={inner}=="}
    assert Converter(rules).convert("<p><mark>m</mark></p>") == "==m=="


def test_urls_in_prose():
    text = "[a](/x) ![b](./y.png)\n\n<source srcset=\"/a 1x, ../b 2x\">\n\n```\n[c](/z)\n```\n\n    [d](/w)\n\n`[e](/v)`"
    out = transform.absolute_urls(text, "https://e.org/d/p")
    assert "[a](https://e.org/x)" in out and "https://e.org/d/y.png" in out and "https://e.org/a 1x, https://e.org/b 2x" in out
    assert "[c](/z)" in out and "[d](/w)" in out and "`[e](/v)`" in out


def test_text_steps():
    assert transform.split_glued_images("![a](b)text\n```\n![a](b)text\n```") == "![a](b)\n\ntext\n```\n![a](b)text\n```"
    assert transform.demote_headings("# a\n```\n# b\n```\n###### c") == "## a\n```\n# b\n```\n###### c"
    headers = {'```js title="x" {1,2} more': "```js", "```js {1,2}": "```js {1,2}", "````markdown theme={null}": "````markdown", "  > ```sh  {x} ": "  > ```sh {x}", "``` ": "``` ", "~~~py": "~~~py"}
    for line, want in headers.items():
        assert transform.clean_fence_headers(f"{line}\na {{1}}").split("\n") == [want, "a {1}"]
    assert transform.plain_long_code("```js\n" + "x" * 101 + "\n```").startswith("```\n")
    assert transform.gap_before_tables("t\n| a |\n| --- |") == "t\n\n| a |\n| --- |"
    assert transform.fix_quotes("> # H\n> text\n> - a\n> -\n> *") == "> **H**\n> text\n>\n> - a\n> \n> "
    assert transform.fix_quotes("> -\n> text after") == "> \n> text after" and transform.fix_quotes("> ```\n> # x\n> ```") == "> ```\n> # x\n> ```"
    assert transform.callout_labels("> **Note:**\n>\n> x") == "> **Note:**\n>\n> \\nopagebreak[4]\n>\n> x"
    assert transform.drop_index_callout("> Documentation Index\n> x\n\n# T") == "# T"
    assert transform.size_images("![a](x/icon-b.png)\n\n### T\n\n![c](d.png)") == "### ![a](x/icon-b.png){width=40px} T\n\n![c](d.png){width=100%}"
    assert "\\allowbreak{}" in transform.breakable_code("`/usr/local/share/x`") and transform.breakable_code("`short`") == "`short`"
    assert transform.link_spacing("[ a ](b)c") == "[a](b) c"


def test_images():
    found = transform.image_references('![a [b]](<u v> "t") `x` \\![n](o)\n```\n![c](d)\n```\n<img src="z" alt="q">')
    assert [(x["url"], x["alt"], x["title"]) for x in found] == [("u v", "a [b]", "t"), ("z", "q", None)]
    text, missing = transform.rewrite_images("![a](https://x/1) ![b](https://x/2)", {"https://x/1": "1.png"})
    assert text == "![a](1.png) ![b](https://x/2)" and missing == ["https://x/2"]


def test_translation():
    plan = transform.translation_plan("---\na: b\n---\n# H\npara\n- item\n\n![x](y)\n```\nc\n```", True)
    assert [s["text"] for s in plan["segments"]] == ["# H\npara", "- item"] and plan["captions"][0]["alt"] == "x"
    out = transform.render_translation(plan, {"md-0": "T"}, {"img-0": "X"}, True)
    assert "# H\npara\n\nT" in out and "- item\n\n- item" in out and "![x](y)\n_X_" in out
    calls = []

    def client(batch):
        calls.append(len(batch))
        if len(batch) > 1:
            raise OSError
        return {k: v.upper() for k, v in batch.items() if v != "no"}

    assert retrying(client, 2, lambda b: {k: "fallback" for k in b})({"a": "x", "b": "no"}) == {"a": "X", "b": "fallback"} and calls == [2, 2, 1, 1]


def test_reference_tables_and_cards():
    field = "| Field | Required | Description |\n| :--- | :--- | :--- |\n| `name` | No | Shown in `` !`a` `` lists. |"
    assert transform.format_tables(field) == "\n\\Needspace{4\\baselineskip}\n\n**Field:** `name` \\hfill{} **Required:** No\n\n\\nopagebreak[4]\n\nShown in `` !`a` `` lists."
    assert transform.format_tables(f"```md\n{field}\n```") == f"```md\n{field}\n```"
    table = "| Key | Type / Values | Details |\n| --- | --- | --- |\n| `a_policy.granular` | `on \\| on-request` | [x](https://y.org)z |\n| two | cells |"
    assert transform.format_tables(table).split("\n") == [
        "| Key | Type / Values | Details |",
        "|:------------------------------------|:----------------------------|:----------------------------------------------------|",
        r"| \texttt{a\_\allowbreak{}policy.\allowbreak{}granular} | \texttt{on |\allowbreak{} on-\allowbreak{}request} | [x](https://y.org) z |",
        "| two | cells |",
    ]
    assert transform.format_tables("| Intent | Flags | Effect |\n| --- | --- | --- |\n| a | `--yolo` | b |").endswith("\n| a | `--yolo` | b |")
    card = "Key\n\n`{}`\n\nType / Values\n\n`string`\n\nDetails\n\nOnly\ncard.\n"
    alone = transform.reference_cards(card.format("k.one"))
    assert alone == "**Key:** `k.one`\n\n**Type / Values:** string\n\n**Details:** Only card.\n\n"
    assert transform.reference_cards(table + "\n\n" + card.format("a_policy.granular") + "\nAfter.") == table + "\n\n\nAfter."
    assert transform.reference_cards(alone + card.format("k.one")).count("Details") == 1
    assert transform.breakable_line("`isolatePeerMachines` `a b` `open/path/to/x") == r"\texttt{isolate\allowbreak{}Peer\allowbreak{}Machines} `a b` `open/path/to/x"


def test_annotations():
    parts = transform.annotation_segments("# H\n\nOne `code` here, one more here.\n\n- item one\n\n| a |\n| - |\n")
    assert [p["text"] for p in parts] == ["One `code` here, one more here.", "item one"]
    note = lambda q, n=1, **x: {"quote": q, "occurrence": n, "explanation": "e", "type": "word", **x}
    assert transform.annotation_violations(parts[0], [note("here", 2)], 1) == []
    assert transform.annotation_violations(parts[0], [note("code"), note("here"), note("here,"), note("gone")], 3) == ["density", "protected", "overlap", "quote_missing"]
    text = "The app works under the hood.\n\n- It gets going.\n"
    parts = [{"id": "a", "text": text[:29], "start": 0, "end": 29, "indent": 0}, {"id": "b", "text": "It gets going.", "start": 33, "end": 47, "indent": 2}]
    idiom = {"quote": "under the hood", "occurrence": 1, "type": "idiom", "explanation": "内部 *实际*", "example": "Look under the hood.", "prompt": "何时用？", "ipa": {"us": "/x/", "uk": "/y/"}}
    logic = {"quote": "gets", "occurrence": 1, "type": "discourse-logic", "explanation": "推进", "example": "It gets better.", "prompt": "为什么？"}
    assert transform.render_annotations(text, parts, {"a": [idiom], "b": [logic, note("gone", type="word", example="E.")]}) == (
        'The app works <span class="english-annotation-source">under the hood</span>.\n\n::: english-annotation\n**英语批注 · 高中**\n\n'
        "- **under the hood**（惯用语 · 英式 IPA /y/ · 美式 IPA /x/）：内部 \\*实际\\*\n\n  **例句：** Look under the hood.\n:::\n\n"
        '- It <span class="english-annotation-source">gets</span> going.\n\n  ::: english-annotation\n  **英语批注 · 高中**\n  \n'
        "  - **gets**（篇章逻辑）：推进\n  \n    **例句：** It gets better.\n  - **gone**（生词）：e\n  \n    **例句：** E.\n  :::\n\n"
        "::: english-learning-review\n**学习回顾 · 先不看批注**\n\n用自己的话回答；答不出时，再回看上方对应批注。\n\n"
        "1. **gets**：为什么？\n2. **under the hood**：何时用？\n:::\n"
    )
    assert transform.render_annotations(text, parts, {}) == text



def test_mdx():
    text = 'import X from "x"\nexport const a = 1\n\n<Steps>\n  <Step title="One">\n    Do `{x}`\n    ```js\n    {b}\n    ```\n  </Step>\n</Steps>\n{"lit"} {-3} {/* no */}'
    out = mdx.strip_mdx(text)
    assert "### One" in out and "`{x}`" in out and "```js\n{b}\n```" in out and "lit -3" in out and "import" not in out
    assert mdx.strip_mdx('<Card title="C" href="/p">b</Card>', "https://e.org/a") == "\n**[C](https://e.org/p)**\n\nb\n"
    assert "> **Note:**" in mdx.strip_mdx("<Info>hi</Info>") and mdx.strip_mdx("<Other>x</Other>") == "x"
    assert mdx.strip_mdx('<img class="dark:hidden" src="a"/>', theme="dark") == ""
    for bad in ("{call()}", "<Empty />", "<Tab>", "</Tab>", "<Card />"):
        with pytest.raises(ValueError):
            mdx.strip_mdx(bad)


def test_adapters():
    site = adapters.Adapter("docs", ("example.org",), None, [adapters.drop_copy_residue, adapters.unwrap_cards, adapters.one_theme, adapters.strip_pager])
    registry = adapters.Registry(site)
    text = "Copy\n[\n\n### T\n\nx\n](/u)\n\n![a](i-light.png)\n\n![a](i-dark.png)\n\n[Next page](/b)\n"
    assert registry.clean(text, "https://docs.example.org/x") == "### [T](/u)\n\nx\n\n\n\n![a](i-light.png)\n"
    assert registry.clean(text, "https://other.org/") == text == registry.clean(text, "https://example.org/", "none")
    root = parse('<div role="tablist"><button role="tab" aria-controls="p">L</button></div><div role="tabpanel" id="p">b</div>')
    adapters.tabs_to_headings(root)
    assert root.html(False) == '<div role="tabpanel" id="p"><h3>L</h3>b</div>'
    assert adapters.decode_props('{"a":[1,[[0,"x"],[0,{"b":[0,2]}]]]}') == {"a": ["x", {"b": 2}]}
    cards = [{"name": "M", "description": "d", "features": [{"title": "Speed", "icons": 2}, {"title": "Ok", "value": True}]}, {"name": "N", "features": [{"title": "Speed", "icons": 4}]}]
    assert adapters.model_cards(cards, ["Note."]) == "### M\n\nd\n\n- Speed: 2/4\n- Ok: Yes\n\n### N\n\n- Speed: 4/4\n\nNote."
    assert adapters.model_cards([{"name": "X", "command": "run x", "features": [{"title": "T"}, {"title": "V", "value": " v "}]}]) == "### X\n\n```bash\nrun x\n```\n\n- T\n- V: v"


def test_site_texts():
    assert adapters.unwrap_cards("[\n\n### Title\n\nSome text\n\n](/u)\n") == "### [Title](/u)\n\nSome text\n\n\n"
    assert adapters.unwrap_cards("[![i](a.png)\n\n## Head\n\nBody\n\n](/u)") == "![i](a.png)\n\n## [Head](/u)\n\nBody\n\n"
    assert adapters.unwrap_cards("[ ![i](a.png)\nPlain title\n\nBody](/u)") == "![i](a.png)\n\n### [Plain title](/u)\n\nBody\n\n"
    assert adapters.unwrap_cards("[\n\n### T\n\nBody\n\nGo on](/u)") == "### T\n\nBody\n\n[Go on](/u)\n\n"
    assert adapters.unwrap_cards("[](/x)\n[a](b)[c](d)") == "\n[a](b)\n[c](d)"
    assert adapters.copied_prompts("![x](y) Do this Copied ![x](z)Do that\nCopied") == "- Do this\n- Do that"
    assert adapters.setup_cards("1. 1\nInstall command\ntext command here") == "1.\n\ntext command here"
    assert adapters.index_page("[A](/c?search=a) [B](/c?search=b)\n## No use cases match these filters\n\nTry clearing a few filters.\n![x](y)\nkept").strip() == "kept"
    assert adapters.glued_tabs({"AppCLI": ["App", "CLI"]})("x\nAppCLI") == "x\n- App\n- CLI"
    assert adapters.one_theme("![S (light mode)](https://a.b/s-light.png) ![S (dark mode)](https://a.b/s-dark.png)") == "![S](https://a.b/s-light.png)"
    for other in ("![S](a-light.png) ![T](a-dark.png)", "![S](a-light.png) ![S](b-dark.png)"):
        assert adapters.one_theme(other) == other
    for pager in ("[Previous\n\nA](/a) [Next\n\nB](/b)\n", "[Next page](/b)", "[Previous page](/a)\n\n[Next page](/b)"):
        assert adapters.strip_pager(f"see [next](/c) there\n\n{pager}").strip() == "see [next](/c) there"
    site = adapters.Adapter("d", ("e.org",), None, [], [(r"/cli/?$", adapters.setup_cards)])
    assert adapters.Registry(site).clean("1. 1", "https://e.org/cli") == "1." and adapters.Registry(site).clean("1. 1", "https://e.org/x") == "1. 1"


def test_pronunciations():
    assert ipa.lookup_word("Don’t") == "don't" and ipa.lookup_word("two words") is None
    assert ipa.uk(["ɪ", "n", "s", "t", "ˈeɪ"]) == "/ɪnˈsteɪ/"
    uk = {"ə d v ˈaɪ z ə ɹ i": "/ədˈvaɪzəri/", "b ˈɐ n d ə l": "/ˈbʌndəl/", "ˈɛ k s t ɹ ə": "/ˈekstrə/", "s ˈɜː f ɪ s": "/ˈsɜːfɪs/", "p ə ɡ ˈɑː": "/pəˈɡɑː/", "k ə n s j ˈuː m": "/kənˈsjuːm/", "ˌ ʌ n ˈd": "/ˌʌˈnd/"}
    assert {k: ipa.uk(k.split()) for k in uk} == uk
    us = {"/oʊˈpeɪk/": "/oʊˈpeɪk/", "/ˈbəndəɫ/": "/ˈbʌndəl/", "/ˈkɫətɝɪŋ/": "/ˈklʌtərɪŋ/", "/ˈwɝd/": "/ˈwɜːrd/", "/ˈdɔtɝ/": "/ˈdɔtər/"}
    assert {k: ipa.us(k) for k in us} == us


def test_control_plane():
    assert files.deep_merge({"a": {"b": 1, "c": [1]}}, {"a": {"c": [2]}}, {"d": None}) == {"a": {"b": 1, "c": [2]}, "d": None}
    assert files.canonical({"b": 1, "a": [{"d": 2, "c": 3}]}) == '{"a":[{"c":3,"d":2}],"b":1}'
    assert files.dotted({"a": {"b": 1}}, "a.b") == 1 and files.dotted({}, "a.b", 5) == 5
    one = files.run_identity(["u", "v"], {"format": "md", "logLevel": "debug", "pdf": {"x": 1}}, batch=True)
    assert one == files.run_identity(["u", "v"], {"format": "md", "pdf": {"x": 2}}, batch=True) != files.run_identity(["v", "u"], {"format": "md"}, batch=True)


def test_files(spark, tmp_path):
    for name, text in (("2-b.md", "# B"), ("10-a.md", "# A"), ("2-b_translated.md", "T"), ("note.txt", "x")):
        (tmp_path / name).write_text(text)
    rows = files.read_markdown(spark, str(tmp_path)).orderBy("position").collect()
    assert [(r["name"], r["text"]) for r in rows] == [("2-b.md", "# B"), ("10-a.md", "# A")]
    assert files.read_json(spark, str(tmp_path / "missing"), files.FAILURES).count() == 0
    old = spark.createDataFrame([("u", 1, "t")], files.FAILURES)
    new = spark.createDataFrame([("u", 1, "x"), ("v", 2, "y"), ("v", 2, "y")], files.FAILURES)
    assert sorted(r["url"] for r in files.merge_log(old, new, ["url", "index"]).collect()) == ["u", "v"]
    assert files.without(new, old, ["url"]).count() == 2
    files.write_report(old, str(tmp_path / "report"))
    assert files.read_json(spark, str(tmp_path / "report"), files.FAILURES).count() == 1
    (tmp_path / "us.tsv").write_text("opaque\t/oʊˈpeɪk/\nBundle\t/x/\nbundle\t/ˈbəndəɫ/\nlead\t/ˈɫɛd/, /ˈɫid/\nbad line\nno\tslash\n")
    assert {tuple(r) for r in files.read_pronunciations(spark, str(tmp_path / "us.tsv")).collect()} == {("opaque", "/oʊˈpeɪk/"), ("bundle", "/ˈbʌndəl/")}
    (tmp_path / "uk.csv").write_text("BUNDLE, b ˈɐ n d ə l\nLEAD(1), l ˈiː d\nTWICE, a\nTwice, b\n\n,x\n")
    assert [tuple(r) for r in files.read_pronunciations(spark, str(tmp_path / "uk.csv"), "uk").collect()] == [("bundle", "/ˈbʌndəl/")]
