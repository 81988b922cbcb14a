r"""Fill-in-the-middle: texts cut at two unit boundaries and written out of order.

A unit grammar says which neighbouring code points stay together. It becomes one
regex of zero width that matches every other place between two code points, so
``split`` at it gives back all units with nothing lost between them.

Edge cases: a null text is an empty one, and an empty text has no units
(``split`` would give one empty piece), so it stays plain. A text that holds a
sentinel stays plain too: what is written can always be read back. A null
``doc_id`` counts as an empty string. Each row is cut by itself, so rows that
repeat an id and a text are cut alike. Columns of any names stay as they are.
An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Names, columns, quoted

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percent of texts that stay plain, and of the others those written suffix first.
PLAIN, SPM = 10, 20

#: Pairs of classes: a code point of the first and one of the second after it stay in one unit.
GRAMMARS: dict[str, list[tuple[str, str]]] = {
    "characters": [],
    "graphemes": [(r"[\s\S]", r"[\p{M}\u200D]"), (r"\u200D", r"[\s\S]"), (r"\r", r"\n")],
    "words": [(r"[^\s]", r"[^\s]"), (r"[\s\S]", r"\s")],
    "lines": [(r"[^\n]", r"[\s\S]")],
    "code": [(r"[\p{L}\p{N}\p{M}_]", r"[\p{L}\p{N}\p{M}_]"), (r"[^\S\n]", r"[^\S\n]")],
}


def boundary(grammar: str | list[tuple[str, str]]) -> str:
    """The zero-width regex of the places where a grammar parts two neighbours.

    Every place with a code point on both sides is one, but for the pairs that
    stay together; between the two halves of a code point beyond 16 bits there
    is no place.
    """
    pairs = GRAMMARS[grammar] if isinstance(grammar, str) else grammar
    return r"(?<=[\s\S])(?=[\s\S])(?![\uDC00-\uDFFF])" + "".join(f"(?!(?<={a}){b})" for a, b in pairs)


def units(text: Column, grammar: str | list[tuple[str, str]] = "characters") -> Column:
    """The units of a text, which joined are the text; an empty text has none."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, boundary(grammar), -1))


def _hashes(doc_id: Column) -> Column:
    """Four unsigned 32-bit numbers that follow from an id."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)])


def fill_in_middle(documents: DataFrame, grammar: str | list[tuple[str, str]] = "characters", plain: int = PLAIN, spm: int = SPM) -> DataFrame:
    """``documents`` and a last column, a struct: n (units), form (plain, psm or spm), prefix, middle, suffix, output.

    The struct is called ``_fim``, with more underscores where the input has
    such a column. Prefix, middle and suffix are null in plain texts.
    """
    n = Names(documents)
    t, u, h = quoted(n.text), quoted(n.units), quoted(n.hashes)
    rows = documents.withColumn(n.text, F.coalesce(F.col("text"), F.lit(""))).withColumn(n.hashes, _hashes(F.col("doc_id")))
    rows = rows.withColumn(n.units, units(t, grammar)).withColumn(n.n, F.size(u).cast("long"))
    size = quoted(n.n)
    form = F.when((size == 0) | t.rlike("<[PSM]>") | (h[2] % 100 >= 100 - plain), "plain").when(h[3] % 100 < spm, "spm").otherwise("psm")
    rows = rows.withColumn(n.form, form).withColumn(n.ends, F.array_sort(F.array(h[0] % (size + 1), h[1] % (size + 1))).cast("array<int>"))
    a, b = quoted(n.ends)[0], quoted(n.ends)[1]
    part = lambda start, length: F.when(quoted(n.form) != "plain", F.array_join(F.slice(u, start + 1, length), ""))
    rows = rows.withColumn(n.prefix, part(F.lit(0), a)).withColumn(n.middle, part(a, b - a)).withColumn(n.suffix, part(b, F.size(u) - b))
    p, m, s = quoted(n.prefix), quoted(n.middle), quoted(n.suffix)
    output = (
        F.when(quoted(n.form) == "plain", t)
        .when(quoted(n.form) == "spm", F.concat(F.lit(SUFFIX), s, F.lit(PREFIX), p, F.lit(MIDDLE), m))
        .otherwise(F.concat(F.lit(PREFIX), p, F.lit(SUFFIX), s, F.lit(MIDDLE), m))
    )
    made = F.struct(size.alias("n"), quoted(n.form).alias("form"), p.alias("prefix"), m.alias("middle"), s.alias("suffix"), output.alias("output"))
    return rows.select(*columns(documents), made.alias(n.fim))


def restore(output: Column, form: Column) -> Column:
    """The text that an output was made from, by the output and its form alone."""
    parts = F.split(output, "<[PSM]>", -1)
    return F.when(form == "plain", output).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(F.concat(parts[1], parts[3], parts[2]))
