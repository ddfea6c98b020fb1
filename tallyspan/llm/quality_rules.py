"""Line-first quality rules: judge every line, remove those that fail, reject documents that lose too much.

Only DataFrame functions: each document is one row of higher-order array functions, so there is no shuffle at
all, and a long document costs n log n (the sort of its own three-word windows).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspan.llm.common import BLANKS, all_columns, table

SYMBOLS = "#*$%&|<>"
#: A line with at least so many bars, and a bar for every so many words, is navigation.
NAV_BARS, NAV_WORDS_A_BAR = 2, 4
#: A line is symbols when they are over this percentage of its characters, shouting when "!!" follows half its words.
SYMBOL_PERCENT = 5
#: A line without closing punctuation is a fragment when it has fewer words than this.
FRAGMENT_WORDS = 4
#: A line that breaks off with an ellipsis is a teaser when it has fewer words than this.
TEASER_WORDS = 8
#: A line in capitals is a heading or shouting from so many words on.
CAPITAL_WORDS = 4
#: Percentage of a document's word characters that its remaining lines must hold.
LEAST_LEFT_PERCENT = 50
#: What a line of prose ends with; the last ones end lines that other rules judge.
CLOSING = list(".!?:;,…。！？\"'”’»)]}|*#$%&")
#: A phrase of boilerplate condemns a line of at most so many characters. This is the rule, not a limit on what is judged:
#: a longer line is a paragraph, in which such a phrase is mentioned; all other rules judge it.
BOILERPLATE_CHARS = 300
#: English, German, French and Spanish.
BOILERPLATE = (
    r"all rights reserved|cookie (policy|settings|notice)|we use cookies|accept (all )?cookies|privacy policy|terms (of|and) (use|service|conditions)"
    r"|enable javascript|subscribe to our|sign up for our|follow us on|click here to|share this (page|article|on)|lorem ipsum|skip to (main )?content|back to top"
    r"|alle rechte vorbehalten|datenschutzerklärung|wir verwenden cookies|cookies akzeptieren|nach oben|zum inhalt springen|newsletter abonnieren"
    r"|tous droits réservés|politique de confidentialité|nous utilisons des cookies|accepter les cookies|mentions légales|aller au contenu|retour en haut"
    r"|todos los derechos reservados|política de privacidad|utilizamos cookies|aceptar (las )?cookies|aviso legal|saltar al contenido|volver arriba"
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is worked out once, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text; an empty array for null."""
    spaced = F.translate(F.coalesce(text, F.lit("")), BLANKS, " " * len(BLANKS))
    return F.filter(F.split(spaced, " "), lambda w: w != "")


def count_of(text: Column, characters: str) -> Column:
    return F.char_length(text) - F.char_length(F.translate(text, characters, ""))


def repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more, the first time included."""
    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.struct(F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("w"), i.alias("at")),
    )
    same = lambda s, x, i: F.coalesce(F.get(s, i)["w"] == x["w"], F.lit(False))
    repeated = let(F.sort_array(windows), lambda s: F.filter(s, lambda x, i: same(s, x, i - 1) | same(s, x, i + 1)))
    spans = let(F.sort_array(F.transform(repeated, lambda x: x["at"])), lambda p: F.transform(p, lambda at, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - at, F.lit(3)))))
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(F.aggregate(spans, F.lit(0), lambda a, x: a + x))


def line_passes(line: Column) -> Column:
    """Whether a line that has a word is text: no navigation, links, symbols, shouting, capitals, teaser, boilerplate or stray fragment.

    Scripts without letter case have no capitals; a short list item without closing punctuation is a fragment.
    """
    n_words, end = F.size(words_of(line)), F.rtrim(line, F.lit(BLANKS))
    chars = F.char_length(F.translate(line, BLANKS, ""))
    bars, shouts = count_of(line, "|"), (F.char_length(line) - F.char_length(F.replace(line, F.lit("!!"), F.lit("")))) / 2
    # each rule begins with a test that is cheap and that most lines do not meet; & leaves off there
    navigation = line.contains("|") & (bars >= NAV_BARS) & (bars * NAV_WORDS_A_BAR >= n_words)
    symbols = line.rlike(f"[{SYMBOLS}]") & (count_of(line, SYMBOLS) * 100 > chars * SYMBOL_PERCENT)
    shouting = line.contains("!!") & (shouts > 1) & (shouts * 2 >= n_words)
    fragment = ~F.right(end, F.lit(1)).isin(CLOSING) & (n_words < FRAGMENT_WORDS)
    links = (line.contains("://") | line.contains("www.")) & (F.regexp_count(line, F.lit(r"(?:https?://|www\.)[^\x20\x09-\x0D]+")) * 2 >= n_words)
    capitals = ~line.rlike(r"\p{Ll}") & line.rlike(r"\p{Lu}{2}[^\n]*\p{Lu}{2}") & (n_words >= CAPITAL_WORDS)
    teaser = (end.endswith("...") | end.endswith("…")) & (n_words < TEASER_WORDS)
    boilerplate = (F.char_length(line) <= BOILERPLATE_CHARS) & F.lower(line).rlike(BOILERPLATE)
    return ~(navigation | links | symbols | shouting | capitals | teaser | fragment | boilerplate)


def judged(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with _words, _lines (that have a word), _left (those that pass, once each) and _text (clean text) beside its own columns."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.withColumns({"_text": text, "_words": words_of(F.col(text_col)), "_lines": lines})
    return out.withColumn("_left", F.array_distinct(F.filter("_lines", line_passes)))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, left_chars, clean_text.

    A null text counts as empty: no words, so base_failed. Rows are judged one by one: repeated rows and ids get
    equal results, other columns are not read, and an empty table gives no rows. Of equal lines in a document the
    first one stays. clean_text holds the lines that stay, one below the other.
    """
    rows = judged(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    n = F.size("_words")
    rows = rows.select(
        "doc_id", n.cast("long").alias("n_words"), F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        count_of(F.col("_text"), SYMBOLS).cast("long").alias("n_symbols"), (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("_words")).cast("long").alias("n_repeat_words"), F.array_join("_left", "\n").alias("clean_text"),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    left = F.char_length(F.translate("clean_text", BLANKS, "")).cast("long")
    rows = rows.withColumns({"base_failed": failed, "left_chars": left})
    return rows.withColumn("kept", ~F.col("base_failed") & (100 * F.col("left_chars") >= LEAST_LEFT_PERCENT * F.col("word_chars")))


def quality_filter(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with the lines that passed as their text; the columns of docs."""
    own = docs.select(all_columns(docs).alias("_row"), F.col("text").alias("_t"))
    fields = {c: F.col(f"doc_id.`{c}`") for c in docs.columns} | {"text": F.col("clean_text")}
    if "n_chars" in fields:
        fields["n_chars"] = F.char_length("clean_text").cast(docs.schema["n_chars"].dataType)
    row = F.struct(F.col("kept"), F.struct(*(v.alias(c) for c, v in fields.items())).alias("row"))
    # a plain where() would be pushed below the projections and work out each array anew for each use of it
    left = measures(own, "_row", "_t").select(F.explode_outer(F.filter(F.array(row), lambda r: r["kept"])).alias("r"))
    return left.where("r is not null").select(*(F.col(f"r.row.`{c}`").alias(c) for c in docs.columns))


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    return measures(table(spark, sf_dir, "documents")).drop("clean_text")
