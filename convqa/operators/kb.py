"""Knowledge base: chunks out of articles, candidates for questions, document pairs, prompt batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convqa.functions import text as tx
from convqa.operators import ordered as o
from convqa.session import materialize

MIN_CHARS = 15


def _clean(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", ""), "\\s+", " "))


def html_blocks(html: str | Column, tag: str) -> Column:
    """Cleaned contents of every non-nested ``tag`` element, empty ones included."""
    found = F.regexp_extract_all(tx.col(html), F.lit(f"(?is)<{tag}(?:\\s[^>]*)?>(.*?)</{tag}>"), F.lit(1))
    return F.transform(found, _clean)


def _filled(blocks: Column) -> Column:
    return F.filter(blocks, lambda b: b != "")


def table_rows(html: str | Column) -> Column:
    """``STRUCT<grp, text>`` per table row: non-empty cells joined with a bar, ``table_i`` by table position."""
    tables = F.regexp_extract_all(tx.col(html), F.lit("(?is)<table(?:\\s[^>]*)?>(.*?)</table>"), F.lit(1))
    def rows(table: Column, i: Column) -> Column:
        found = F.regexp_extract_all(table, F.lit("(?is)<tr(?:\\s[^>]*)?>(.*?)</tr>"), F.lit(1))
        cells = lambda r: _filled(F.transform(F.regexp_extract_all(r, F.lit("(?is)<t[dh](?:\\s[^>]*)?>(.*?)</t[dh]>"), F.lit(1)), _clean))
        return F.transform(found, lambda r: F.struct(
            F.concat(F.lit("table_"), i.cast("string")).alias("grp"), F.array_join(cells(r), " | ").alias("text")))
    return F.filter(F.flatten(F.transform(tables, rows)), lambda r: r["text"] != "")


def list_rows(html: str | Column) -> Column:
    """List items in the form of table rows, one group per list."""
    lists = F.regexp_extract_all(tx.col(html), F.lit("(?is)<(?:ul|ol)(?:\\s[^>]*)?>(.*?)</(?:ul|ol)>"), F.lit(1))
    return F.filter(F.flatten(F.transform(lists, lambda l, i: F.transform(
        html_blocks(l, "li"), lambda t: F.struct(F.concat(F.lit("list_"), i.cast("string")).alias("grp"), t.alias("text"))
    ))), lambda r: r["text"] != "")


def _first_of_text(rows: Column) -> Column:
    texts = F.transform(rows, lambda r: r["text"])
    return F.filter(rows, lambda r, i: F.array_position(texts, r["text"]) == i + 1)


def extract_chunks(pages: DataFrame, ident: str = "page_id", html: str = "html", with_lists: bool = True) -> DataFrame:
    """Chunks of each article: its paragraphs, then its table (and list) rows without repeats.

    Numbering follows the order inside one article, so everything happens within its row: no shuffle.
    """
    rows = F.concat(table_rows(html), list_rows(html)) if with_lists else table_rows(html)
    paragraphs = F.transform(_filled(html_blocks(html, "p")), lambda p: F.struct(
        F.lit("paragraph").alias("type"), F.lit(None).cast("string").alias("grp"), p.alias("text")))
    tail = F.transform(_first_of_text(rows), lambda r: F.struct(F.lit("table_row").alias("type"), r["grp"].alias("grp"), r["text"].alias("text")))
    return pages.select(ident, F.posexplode(F.concat(paragraphs, tail)).alias("pos", "c")).select(
        ident, tx.padded_id("chunk_", F.col("pos") + 1).alias("id"), "c.type", "c.text", tx.detect_language("c.text").alias("language"), "c.grp",
    )


def first_occurrences(rows: DataFrame, keys: Sequence[str], text: str, position: Sequence[str]) -> DataFrame:
    """First row of every distinct text within ``keys`` (mergeable, so repeats vanish before the shuffle)."""
    at = F.min(F.struct(*position)).alias("__at")
    return rows.groupBy(*keys, text).agg(at).select(*keys, text, "__at.*")


def usable(chunks: DataFrame, text: str = "text", minimum: int = MIN_CHARS) -> DataFrame:
    return chunks.where(F.length(text) >= minimum)


def chunk_counts(chunks: DataFrame) -> DataFrame:
    """Chunks by language and by type in one pass; ``scope`` says by which."""
    out = chunks.groupingSets([["language"], ["type"]], "language", "type").agg(F.count(F.lit(1)).alias("chunks"), F.grouping("language").alias("__g"))
    return out.withColumn("scope", F.when(F.col("__g") == 1, "type").otherwise("language")).drop("__g")


def candidates(chunks: DataFrame, order: str = "ord", block_rows: int = o.DEFAULT_BLOCK_ROWS) -> DataFrame:
    """Question sources: every usable chunk, plus the first two of each group, interleaved one to one.

    Input ``id, text, grp`` and an integer order; output ``pos, kind, first_id, second_id``.
    """
    good = usable(chunks)
    standalone = o.ordinal(good.select("id", order), [], [order], "n", o.blocks_of(order, block_rows)).select(
        "n", F.lit("standalone").alias("kind"), F.lit(0).alias("k"), F.col("id").alias("first_id"), F.lit(None).cast(dict(chunks.dtypes)["id"]).alias("second_id"))
    # The two smallest of a group are a mergeable aggregate; the first of what is left is the second.
    grouped = good.where(F.col("grp").isNotNull())
    first = grouped.groupBy("grp").agg(F.min(F.struct(order, "id")).alias("a"))
    rest = grouped.join(first, "grp").where(F.col(order) > F.col(f"a.{order}"))
    pair = rest.groupBy("grp", "a").agg(F.min(F.struct(order, "id")).alias("b")).select(F.col(f"a.{order}").alias("at"), "a", "b")
    combined = o.ordinal(pair, [], ["at"], "n", o.blocks_of("at", block_rows)).select(
        "n", F.lit("combined").alias("kind"), F.lit(1).alias("k"), F.col("a.id").alias("first_id"), F.col("b.id").alias("second_id"))
    both = standalone.unionByName(combined)
    return o.ordinal(both, [], ["n", "k"], "pos", o.blocks_of("n", block_rows)).drop("n", "k")


def resolve_chunks(questions: DataFrame, chunks: DataFrame, ident: str = "id") -> DataFrame:
    """Texts of a question's chunk ids in their order; unknown ids are dropped."""
    refs = questions.select(ident, F.posexplode("chunk_ids").alias("__at", "chunk_id"))
    texts = chunks.where(F.coalesce("text", F.lit("")) != "").select(F.col("id").alias("chunk_id"), F.col("text").alias("__text"))
    found = refs.join(texts, "chunk_id").groupBy(ident).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("__at", "__text"))), lambda s: s["__text"]).alias("source_chunks"))
    return questions.drop("source_chunks").join(found, ident, "left").withColumn(
        "source_chunks", F.coalesce("source_chunks", F.array().cast("array<string>")))


def pair_documents(ar: DataFrame, en: DataFrame, manual: DataFrame) -> DataFrame:
    """Pair two lists of documents (``idx`` from 1, ``file``): manual names first, then the same position.

    A partner is taken once, by the earliest document that wants it; a document whose manual partner is
    gone falls back to its own position. ``manual``: ``ar, en`` file names. Output: ``idx, ar_file,
    en_file, how``; unpaired documents keep a null on the other side.

    Only the first claimant of a partner can get it by name, and it loses it only when the document at
    that position came earlier and did not get a manual partner itself. So every open claim has the
    outcome of the claim it points to, and pointers are doubled until all outcomes are known.
    """
    fold = lambda c: F.lower(tx.strip(c))
    left = ar.select("idx", F.col("file").alias("ar_file"), fold("file").alias("__ar"))
    right = en.select(F.col("idx").alias("en_idx"), F.col("file").alias("en_file"), fold("file").alias("__en"))
    wishes = manual.groupBy(fold("ar").alias("__ar")).agg(F.max(fold("en")).alias("__en"))
    wanted = left.join(wishes, "__ar").join(right, "__en").select("idx", "en_idx")
    first = wanted.groupBy("en_idx").agg(F.min("idx").alias("idx"))
    exists = left.select(F.col("idx").alias("en_idx"), F.lit(True).alias("__exists"))
    claims = first.join(exists, "en_idx", "left").select("idx", "en_idx", (F.col("__exists").isNotNull() & (F.col("en_idx") < F.col("idx"))).alias("open"))
    state = left.select("idx").join(claims, "idx", "left").select(
        "idx", F.when(F.col("open"), F.col("en_idx")).alias("ptr"), F.when(~F.coalesce("open", F.lit(False)), F.col("en_idx").isNotNull()).alias("got"))
    while not state.where("got is null").isEmpty():
        target = state.select(F.col("idx").alias("ptr"), F.col("ptr").alias("__ptr"), F.col("got").alias("__got"))
        state = materialize(state.join(target, "ptr", "left").select(
            "idx", F.when(F.col("got").isNull(), F.col("__ptr")).alias("ptr"), F.coalesce("got", "__got").alias("got")), "pairs")
    by_name = claims.join(state.where("got").select("idx"), "idx").select("idx", "en_idx", F.lit("manual").alias("how"))
    taken = by_name.select("en_idx", F.col("idx").alias("__by"))
    by_position = (
        state.where("not got").select("idx", F.col("idx").alias("en_idx")).join(right.select("en_idx"), "en_idx")
        .join(taken, "en_idx", "left").where(F.col("__by").isNull() | (F.col("__by") > F.col("idx")))
        .select("idx", "en_idx", F.lit("position").alias("how")))
    pairs = by_name.unionByName(by_position)
    paired = left.join(pairs, "idx", "left").join(right, "en_idx", "left").select(
        "idx", "ar_file", "en_file", F.coalesce("how", F.lit("unpaired_ar")).alias("how"))
    rest = right.join(pairs, "en_idx", "left_anti").select(
        F.lit(None).cast(dict(ar.dtypes)["idx"]).alias("idx"), F.lit(None).cast("string").alias("ar_file"), "en_file", F.lit("unpaired_en").alias("how"))
    return paired.unionByName(rest)


def batches(df: DataFrame, order: str, size: int = 8, block_rows: int = o.DEFAULT_BLOCK_ROWS) -> DataFrame:
    """Fixed-size batches in order: adds ``batch`` from 1 and ``slot`` from 1."""
    numbered = o.ordinal(df, [], [order], "__rn", o.blocks_of(order, block_rows))
    return numbered.withColumn("batch", F.expr(f"(__rn - 1) div {size} + 1")).withColumn("slot", F.expr(f"(__rn - 1) % {size} + 1")).drop("__rn")


def document_text(slug: str, lang: str, file: str, paragraphs: str, rows: str) -> Column:
    """One document in prompt form."""
    head = F.concat(F.lit("FLOW: "), F.col(slug), F.lit("  ("), F.upper(lang), F.lit(", file: "), F.col(file), F.lit(")"))
    listed = F.transform(F.coalesce(rows, F.array().cast("array<string>")), lambda r: F.concat(F.lit("  - "), r))
    table = F.when(F.size(listed) > 0, F.concat(F.array(F.lit("TABLE 1:")), listed)).otherwise(listed)
    return F.array_join(F.concat(F.array(head), F.col(paragraphs), table), "\n")


def prompt_batches(documents: DataFrame, order: str, instructions: str = "", size: int = 8) -> DataFrame:
    """One prompt per batch of documents (``slug`` and ready ``doc_text``) with the real batch size in it,
    and the list of flows for the manifest."""
    cut = batches(documents, order, size)
    grouped = cut.groupBy("batch").agg(
        F.count(F.lit(1)).alias("docs"), F.array_sort(F.collect_list(F.struct("slot", "slug", "doc_text"))).alias("d"))
    slugs = F.array_join(F.transform("d", lambda x: x["slug"]), ", ")
    texts = F.array_join(F.transform("d", lambda x: F.concat(x["doc_text"], F.lit("\n\n---"))), "\n")
    head = F.replace(F.lit(instructions), F.lit("{count}"), F.col("docs").cast("string"))
    return grouped.select(
        tx.padded_id("batch-", "batch").alias("file"), "docs", slugs.alias("flows"),
        F.concat_ws("\n", head, F.lit(""), F.concat(F.lit("BATCH: "), slugs), F.lit(""), texts).alias("prompt"),
    )


def select_flows(flows: DataFrame, numbers: Sequence[int] = (), position: str = "index") -> DataFrame:
    """Flows at the given positions; none given keeps all."""
    return flows.where(F.col(position).isin([int(n) for n in numbers])) if numbers else flows
