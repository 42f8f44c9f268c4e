"""Removal of lines whose template recurs across documents, by a log-template tree.

The tree has a fixed depth: lines are told apart by their token count and their leading
tokens (up to ``LEADING``; tokens with a digit count as variable there and everywhere). In a
leaf, a token is constant at its place if at least ``min_docs`` different texts have it there;
other places are variable fields. A line's template is its constant tokens, provided they are
at least ``constant`` of its tokens. A template recurs when it stands in at least
``min_docs`` different texts, so exact copies of a document count once; recurring lines are
dropped from every document.

With ``sources``, texts that are alike count once as well, however many there are: a template
recurs when it stands in at least ``min_docs`` sources. Texts are alike when their
sketches (the smallest three-word hash in each of ``BINS`` bins) agree in at least ``ALIKE``
of the bins that either fills; each text is compared with the smallest text of every bucket
of equal values, and links are closed over components. Near copies then keep their lines,
for document deduplication to meet.

All steps are DataFrame functions; only hashes of lines are shuffled until the tokens of
different lines in crowded leaves are looked at. Documents and texts are named by 128-bit
hashes.

Edge cases: a null text stays null with no lines; a line without tokens stays; a document may
lose all lines and keeps an empty text; repeated rows (same id and text) count as one
document; a null ``doc_id`` is an id of its own; an empty table gives an empty result; other
columns pass through, those named like a result are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadpass.llm.components import components
from roadpass.llm.scratch import release, stored

MIN_DOCS = 5
CONSTANT = 0.6
LEADING = 3
# Bins of a text's sketch, and the share of them in which copies of one source agree.
BINS, ALIKE = 64, 0.5

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"
VARIABLE = "<*>"
RESULTS = ("n_lines", "n_dropped")


def drop_recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS, constant: float = CONSTANT) -> DataFrame:
    """``docs`` with recurring lines taken out of ``text``, and n_lines and n_dropped added."""
    cut = cut_lines(docs, min_docs, constant)
    kept = [c for c in docs.columns if c.lower() not in RESULTS]
    return cut.select(*(F.col("text") if c == "text" else F.col("d").getField(c).alias(c) for c in kept), *RESULTS)


def cut_lines(docs: DataFrame, min_docs: int = MIN_DOCS, constant: float = CONSTANT, sources: bool = False) -> DataFrame:
    """d (the row as it was), text without recurring lines, n_lines and n_dropped."""
    drops = recurring_lines(docs, min_docs, constant, sources)
    listed = drops.groupBy("row").agg(F.sort_array(F.collect_list("n")).alias("gone"))
    lists = stored(listed.select("row", F.size("gone").alias("count"), marks("gone").alias("marks")), "dropped-lines")
    whole = docs.select(F.struct("*").alias("d"), row_key(F.col("doc_id"), F.col("text")).alias("row"))
    # The lists grow with the documents, so the join is shuffled at every size.
    both = whole.join(lists.hint("merge"), "row", "left")
    lines = F.split("d.text", "\n", -1)
    kept = F.filter(lines, lambda line, i: ~marked(i))
    return both.select(
        "d",
        F.when(F.col("marks").isNull(), F.col("d.text")).otherwise(F.array_join(kept, "\n")).alias("text"),
        F.when(F.col("d.text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.coalesce("count", F.lit(0)).cast("long").alias("n_dropped"),
    )


def marks(places: str) -> Column:
    """A byte a line up to the last of the sorted places, so that telling a line takes no search."""
    gap = F.transform(places, lambda n, i: F.concat(F.repeat(F.lit("0"), n - F.coalesce(F.get(places, i - 1), F.lit(-1)) - 1), F.lit("1")))
    return F.array_join(gap, "").cast("binary")


def marked(i: Column) -> Column:
    return F.substring("marks", i + 1, F.lit(1)) == F.lit(b"1")


def row_key(doc_id: Column, text: Column) -> Column:
    """A name of a document: 128 bits of its id and text."""
    return F.unhex(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), text)))


def text_key() -> Column:
    return F.unhex(F.md5("text"))


def masked(line: Column) -> Column:
    """The line with tokens that hold a digit replaced."""
    return F.when(line.rlike("[0-9]"), F.regexp_replace(line, f"{WORD}*[0-9]{WORD}*", VARIABLE)).otherwise(line)


def recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS, constant: float = CONSTANT, sources: bool = False) -> DataFrame:
    """(row, n): line n (from 0) of the document with that key recurs."""
    texts = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("row"), text_key().alias("whole"), "text").where("text is not null")
    # Names are made below the explode, once a text and not once a line.
    flat = texts.select("row", "whole", F.posexplode(F.split("text", "\n", -1)).alias("n", "line"))
    flat = flat.withColumn("line", masked(F.col("line")))
    lead = F.regexp_extract("line", f"^{SPACE}*((?:{WORD}+{SPACE}+){{0,{LEADING - 1}}}{WORD}+)", 1)
    keys = stored(
        flat.withColumn("lead", lead)
        .where("lead <> ''")
        .select(
            "row",
            "n",
            F.xxhash64(F.regexp_count("line", F.lit(f"{WORD}+")), "lead").alias("leaf"),
            F.xxhash64("line").alias("line"),
            "whole",
        ),
        "line-keys",
    )
    leaves = stored(
        keys.select("leaf", "whole").distinct().groupBy("leaf").count().where(F.col("count") >= min_docs).select("leaf"), "crowded-leaves"
    )
    crowded = stored(keys.join(leaves, "leaf"), "crowded-lines")
    release(keys, leaves)
    variants = stored(
        crowded.groupBy("leaf", "line", "whole")
        .agg(F.min(F.struct("row", "n")).alias("at"))
        .groupBy("leaf", "line")
        .agg(F.count("*").alias("docs"), F.min("at").alias("at")),
        "line-variants",
    )
    templates = _templates(texts, variants, min_docs, constant)
    placed = stored(crowded.join(templates, ["leaf", "line"]).select("row", "n", "template", "whole"), "templated-lines")
    release(crowded, variants, templates)
    # A row for each text that holds a template, and one document to read that text from.
    held = placed.groupBy("template", "whole").agg(F.min("row").alias("row"))
    held = _sources(texts, held, min_docs) if sources else held
    many = held.groupBy("template").agg(F.count("*").alias("wholes")).where(F.col("wholes") >= min_docs)
    recurring = stored(many.select("template"), "recurring-templates")
    # Rows repeated in the table name the same lines twice.
    found = stored(placed.join(recurring, "template").select("row", "n").distinct(), "recurring-lines")
    release(placed, recurring, *([held] if sources else []))
    return found


def _sources(texts: DataFrame, held: DataFrame, min_docs: int) -> DataFrame:
    """The different (template, whole) with texts that are alike under one of their keys."""
    many = held.groupBy("template").count().where(F.col("count") >= min_docs).select("template")
    held = stored(held.join(many, "template"), "held-templates")
    # Each text is read from one of its documents, so its copies are not gathered.
    wanted = held.groupBy("whole").agg(F.min("row").alias("row")).select("row")
    chosen = texts.join(wanted, "row").groupBy("whole").agg(F.first("text").alias("text"))
    words = F.filter(F.split(F.lower("text"), f"{SPACE}+"), lambda t: t != "")
    shingles = F.arrays_zip(
        words.alias("a"), F.slice(words, 2, F.size(words)).alias("b"), F.slice(words, 3, F.size(words)).alias("c")
    )
    sketch = stored(
        chosen.select("whole", F.explode(shingles).alias("s"))
        .select("whole", F.xxhash64("s.a", "s.b", "s.c").alias("h"))
        .groupBy("whole", F.pmod("h", F.lit(BINS)).alias("bin"))
        .agg(F.min("h").alias("h"))
        .select("whole", "h"),
        "line-sketches",
    )
    sketches = stored(sketch.groupBy("whole").agg(F.collect_list("h").alias("values")), "whole-sketches")
    hubs = sketch.groupBy("h").agg(F.min("whole").alias("hub"), F.max("whole").alias("top")).where("hub <> top").select("h", "hub")
    met = sketch.join(hubs, "h").where("whole <> hub").groupBy("whole", "hub").agg(F.count("*").alias("shared"))
    one = sketches.select("whole", F.col("values").alias("x"))
    other = sketches.select(F.col("whole").alias("hub"), F.col("values").alias("y"))
    # Few values in common with a hub do not make a pair worth a comparison.
    pairs = met.join(one, "whole").where(F.col("shared") * 8 >= F.size("x")).select("whole", "hub", "x").join(other, "hub")
    bins = [F.transform(c, lambda h: F.pmod(h, F.lit(BINS))) for c in ("x", "y")]
    links = pairs.where(F.size(F.array_intersect("x", "y")) >= ALIKE * F.size(F.array_union(*bins)))
    named_by = components(links.select(F.col("whole").alias("a"), F.col("hub").alias("b")))
    named = named_by.withColumnRenamed("node", "whole")
    found = stored(
        held.join(named, "whole", "left").select("template", F.coalesce("component", "whole").alias("whole")).distinct(),
        "template-sources",
    )
    release(held, sketch, sketches, named_by)
    return found


def _templates(texts: DataFrame, variants: DataFrame, min_docs: int, constant: float) -> DataFrame:
    """(leaf, line, template) of the different lines that have enough constant tokens."""
    # Each different line is read at one place where it occurs.
    listed = F.sort_array(F.collect_list(F.struct("at.n", "leaf", "line", "docs"))).alias("lines")
    wanted = variants.groupBy(F.col("at.row").alias("row")).agg(listed).select("row", "lines", F.col("lines.n").alias("places"))
    wanted = stored(wanted.select("row", "lines", marks("places").alias("marks")), "wanted-lines")
    found = F.filter(F.split("text", "\n", -1), lambda line, i: marked(i)).alias("found")
    chosen = texts.dropDuplicates(["row"]).join(wanted, "row").select(F.explode(F.arrays_zip(found, F.col("lines").alias("w"))).alias("r"))
    words = F.filter(F.split(masked(F.col("r.found")), f"{SPACE}+"), lambda t: t != "")
    tokens = stored(
        chosen.select("r.w.leaf", "r.w.line", "r.w.docs", F.posexplode(words).alias("pos", "token")).select(
            "leaf", "line", "docs", F.xxhash64("pos", "token").alias("token"), (F.col("token") == VARIABLE).alias("variable")
        ),
        "line-tokens",
    )
    support = stored(
        tokens.where("not variable").groupBy("leaf", "token").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).select("leaf", "token"),
        "constant-tokens",
    )
    fixed = tokens.where("not variable").join(support, ["leaf", "token"]).groupBy("leaf", "line").agg(
        F.count("*").alias("constants"),
        # Each token is hashed with its place, so the sum does not depend on order.
        F.sum(F.col("token").cast("decimal(20,0)")).alias("sum"),
    )
    sizes = tokens.groupBy("leaf", "line").agg(F.count("*").alias("size"))
    found = stored(
        fixed.join(sizes, ["leaf", "line"])
        .where(F.col("constants") >= constant * F.col("size"))
        .select("leaf", "line", F.xxhash64("leaf", "constants", F.col("sum").cast("string")).alias("template")),
        "templates",
    )
    release(wanted, tokens, support)
    return found
