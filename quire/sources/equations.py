"""Formulas on one line of text, from their elements as rows.

The markup puts an element's slots in the order in which they are written, so a formula's line is the
texts of its runs with signs before, between and behind the slots, in document order. SLOTS and WHOLE
say which signs; nothing is walked.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.operators.arrays import let

# The written forms. Around a slot (element/slot), and around an element: what stands
# before and behind; {name} is the property of that name, after the bar its default.
SLOTS = {
    "f/num": ("(", ")"), "f/e": ("(", ")"), "f/den": ("{type|bar}(", ")"),
    "rad/deg": ("\u0003", "\u0004"), "rad/e": ("(", ")"),
    "sSub/sub": ("_(", ")"), "sSup/sup": ("^(", ")"), "sSubSup/sub": ("_(", ")"), "sSubSup/sup": ("^(", ")"),
    "sPre/sub": ("", " "), "sPre/sup": ("\u0005^(", ") \u0006"),
    "nary/sub": ("\u0005_(", ")\u0006"), "nary/sup": ("\u0005^(", ")\u0006"), "nary/e": (" ", ""),
    "func/e": (" ", ""), "limLow/lim": ("_(", ")"), "limUpp/lim": ("^(", ")"),
    "groupChr/e": ("(", ")"), "bar/e": ("(", ")"),
}
BETWEEN = {"d/e": "{sepChr||}", "m/mr": "; ", "mr/e": ", ", "eqArr/e": "; "}
WHOLE = {
    "rad": ("√", ""), "nary": ("{chr|∫}", ""), "d": ("{begChr|(}", "{endChr|)}"), "acc": ("", "{chr|̂}"),
    "bar": ("{under}", "{over}"), "groupChr": ("{brace}", ""), "m": ("(", ")"), "func": ("", ""),
}
RAISED = {"1": "¹", "2": "²", "3": "³"}
UNDER, OVER, BRACE_UNDER, BRACE_OVER = "̲", "̅", "⏟", "⏞"

PARTS = ["e", "num", "den", "sub", "sup", "deg", "lim", "fName"]
PROPERTIES = ["type", "degHide", "chr", "begChr", "sepChr", "endChr", "pos", "vertJc"]
ELEMENTS = ["f", "rad", "sSub", "sSup", "sSubSup", "sPre", "nary", "func", "limLow", "limUpp", "groupChr", "bar", "d", "m", "mr", "eqArr", "acc", "oMath", "oMathPara"]
TAGS = {f"m:{x}" for x in [*PARTS, *PROPERTIES, *ELEMENTS, "t", "br"]} | {"w:br"}


def node() -> Column:
    """What equation_text needs of a row of markup.xml_places."""
    return F.struct("pre", "post", "up", "upper", F.regexp_replace("tag", "^(m|w):", "").alias("tag"), F.regexp_replace(F.coalesce("over", F.lit("")), "^m:", "").alias("over"), "twin", F.col("a_m_val").alias("val"), "text")


def _given(props: Column, owner: Column, name: str) -> Column:
    """The owner's first property of that name; null if it has none."""
    return F.try_element_at(F.filter(props, lambda p: (p["owner"] == owner) & (p["name"] == name)), F.lit(1))["val"]


def _sign(form: str, props: Column, owner: Column) -> Column:
    """A written form with the owner's property filled in."""
    if form.startswith("{under") or form.startswith("{over"):
        low = F.coalesce(_given(props, owner, "pos"), F.lit("top")) == "bot"
        return F.when(low, UNDER if form == "{under}" else "").otherwise("" if form == "{under}" else OVER)
    if form == "{brace}":
        high = F.coalesce(_given(props, owner, "pos"), _given(props, owner, "vertJc"), F.lit("bot")) == "top"
        return F.coalesce(_given(props, owner, "chr"), F.when(high, BRACE_OVER).otherwise(BRACE_UNDER))
    if form.startswith("{type"):
        bare = F.coalesce(_given(props, owner, "type"), F.lit("bar")).isin("lin", "noBar")
        return F.concat(F.when(bare, "/").otherwise(" / "), F.lit(form.partition("}")[2]))
    if form.startswith("{"):
        name, _, default = form[1:-1].partition("|")
        return F.coalesce(_given(props, owner, name), F.lit(default))
    return F.lit(form)


def _choice(cases: list[tuple[Column, Column]]) -> Column:
    out = F.lit("")
    for when, then in reversed(cases):
        out = F.when(when, then).otherwise(out)
    return out


def equation_text(nodes: Column) -> Column:
    """An array of node() of one formula -> its line: fractions as (a) / (b), roots as √(x), scripts as x_(i)^(n), a matrix's rows between semicolons."""
    props = F.transform(F.filter(nodes, lambda x: x["tag"].isin(*PROPERTIES) & x["over"].endswith("Pr") & x["val"].isNotNull()), lambda x: F.struct(x["upper"].alias("owner"), x["tag"].alias("name"), x["val"].alias("val")))

    def signs(x: Column, slot: Column, props: Column) -> Column:
        is_part = x["tag"].isin(*PARTS)
        before = [(slot == k, _sign(b, props, x["up"])) for k, (b, _) in SLOTS.items() if b]
        before += [(slot == k, F.when(x["twin"] > 0, _sign(s, props, x["up"])).otherwise("")) for k, s in BETWEEN.items()]
        before += [(x["tag"] == k, _sign(b, props, x["pre"])) for k, (b, _) in WHOLE.items() if b]
        behind = [(slot == k, F.lit(b)) for k, (_, b) in SLOTS.items() if b]
        behind += [(x["tag"] == k, _sign(b, props, x["pre"])) for k, (_, b) in WHOLE.items() if b]
        own = F.when(x["tag"] == "t", F.coalesce(x["text"], F.lit(""))).when(x["tag"] == "br", "\n").otherwise("")
        plain = x["tag"].isin("t", "br")
        opened = F.when(plain, own).otherwise(F.concat(_choice(before), F.when(is_part, "\u0001").otherwise("")))
        closed = F.when(plain, "").otherwise(F.concat(F.when(is_part | x["tag"].isin("nary", "func"), "\u0002").otherwise(""), _choice(behind)))
        return F.array(F.struct(x["pre"].alias("at"), opened.alias("sign")), F.struct(x["post"].alias("at"), closed.alias("sign")))

    def joined(props: Column, hidden: Column) -> Column:
        kept = F.filter(nodes, lambda x: ~x["over"].endswith("Pr") & ~F.exists(hidden, lambda h: (h["pre"] <= x["pre"]) & (x["post"] <= h["post"])))
        each = F.transform(kept, lambda x: let(F.concat(x["over"], F.lit("/"), x["tag"]), lambda slot: signs(x, slot, props)))
        return F.array_join(F.transform(F.sort_array(F.flatten(each)), lambda x: x["sign"]), "")

    def not_shown(props: Column) -> Column:
        return F.filter(nodes, lambda x: (x["tag"] == "deg") & ~F.coalesce(_given(props, x["up"], "degHide"), F.lit("1")).isin("0", "off", "false"))

    line = let(props, lambda props: let(not_shown(props), lambda hidden: joined(props, hidden)))
    # marks that no XML can hold: 1 and 2 begin and end a slot, 3 and 4 a root's degree, 5 and 6 what goes if it is empty
    line = F.regexp_replace(line, "\u0001[\\s\u0001]*", "")
    line = F.regexp_replace(line, "[\\s\u0002]*\u0002", "")
    line = F.regexp_replace(line, "\u0005[_^]\\(\\) ?\u0006", "")
    for figure, raised in RAISED.items():
        line = F.regexp_replace(line, f"√\u0003{figure}\u0004", f"{raised}√")
    line = F.translate(F.regexp_replace(line, "\u0003\u0004", ""), "\u0003\u0004\u0005\u0006", "()")
    return F.trim(F.regexp_replace(line, r"\s+", " "))
