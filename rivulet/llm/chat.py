"""Chat formatting: every dialogue from the point of view of each participant.

For each participant the whole dialogue is rendered with that speaker as the
assistant and all others as named users. The result has one row for each
message of each rendering: its text, where it stands in the rendering, and which
characters of it are to be learned. Rendering positions are running sums in three
steps: over the chunks of turns of a dialogue, within a chunk over its turns, speakers and
beginnings of hashes, and within these over messages. So neither one endless
dialogue nor one turn with endless messages is gathered in a single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rivulet.llm.common import HOT, lookup, materialise

SYSTEM = "system"
END = "<|end|>\n"
#: Turns in a chunk.
CHUNK = 64
#: Messages, or points of view, of a dialogue that meet in one task; in small tables fewer.
BLOCK = 4096


def escaped(text: F.Column) -> F.Column:
    """The text with one more bar after each ``<|``, so that it holds no mark; taking the bar out again gives the text back."""
    return F.replace(text, F.lit("<|"), F.lit("<||"))


def casts(rows: DataFrame) -> DataFrame:
    """(dialogue, speaker, n, name, renamed) from (dialogue, speaker): the speakers of each dialogue, their rows and their names.

    A name has letters, digits, ``_`` and ``-``. Of several speakers of a dialogue that would have
    the same one, the second and later ones, in code-point order, get ``.2`` and so on.
    """
    people = rows.groupBy("dialogue", "speaker").agg(F.count("*").alias("n")).withColumn("safe", safe_name("speaker"))
    k = F.row_number().over(Window.partitionBy("dialogue", "safe").orderBy("speaker"))
    name = F.when(k == 1, F.col("safe")).otherwise(F.concat_ws(".", "safe", k.cast("string")))
    return people.select("dialogue", "speaker", "n", name.alias("name"), (k > 1).alias("renamed"))


def safe_name(speaker: str) -> F.Column:
    return F.regexp_replace(speaker, "[^A-Za-z0-9_-]", "_")


def with_names(rows: DataFrame, people: DataFrame, total: int) -> DataFrame:
    """``rows`` (dialogue, speaker, ...) with each speaker's name. Only where names are not the speakers' own is anything joined."""
    if people.where("renamed").isEmpty():
        return rows.withColumn("name", safe_name("speaker"))
    who = F.concat_ws(":", F.length("dialogue").cast("string"), "dialogue", "speaker")
    return lookup(rows.withColumn("who", who), materialise(people.select(who.alias("who"), "name", "n"), "names"), "who", total).drop("who")


def with_perspectives(rows: DataFrame, people: DataFrame, total: int, block: int | None = None) -> DataFrame:
    """Each of ``rows`` (dialogue, turn, speaker, h, ...; ``total`` of them) once for every ``perspective`` of its dialogue.

    The messages of a dialogue are dealt to blocks, and so are its points of view; each block of messages
    meets each block of views in one task. So neither endless messages nor a cast without end are in one place.
    """
    block = block or min(BLOCK, max(32, total // HOT))
    viewed = F.col("speaker") != SYSTEM
    views = people.where(viewed).select("dialogue", F.col("speaker").alias("perspective"))
    blocks = lambda n: F.ceil(F.col(n) / block).cast("bigint")
    sizes = people.groupBy("dialogue").agg(F.sum("n").alias("n"), F.count_if(viewed).alias("v")).where("v > 0")
    sizes = materialise(sizes.withColumns({"_rows": blocks("n"), "_views": blocks("v")}), "casts")
    if sizes.where("_rows > 1 OR _views > 1").isEmpty():
        return rows.join(views, "dialogue")
    n_views = sizes.agg(F.sum("v")).first()[0]
    own = lambda n, *by: F.pmod(F.xxhash64(*by), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    dealt = lookup(rows, sizes.drop("v"), "dialogue", total).select("*", own("_rows", "turn", "speaker", "h").alias("_i"), every("_views").alias("_j")).drop("_rows", "_views")
    views = lookup(views, sizes.drop("n").withColumnRenamed("v", "n"), "dialogue", n_views).select("dialogue", "perspective", own("_views", "perspective").alias("_j"), every("_rows").alias("_i"))
    return dealt.join(views, ["dialogue", "_i", "_j"]).drop("_i", "_j")


def perspectives(turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(conv_id, perspective, seq, turn, speaker, segment, start, end, mask_start, mask_end).

    ``turns`` has conv_id, turn, role and text; other columns are left aside, whatever their names.
    The concatenation of a rendering's segments by ``seq`` is its text; ``start`` and
    ``end`` count its characters, and [mask_start, mask_end) is what to learn: text
    and end mark (without its line end) of the assistant's messages, nothing (mask_start = mask_end) of
    others. Marks within a text are escaped. A null role is the speaker ``unknown``; ``system`` messages are part
    of each rendering but no point of view, so a dialogue of system
    messages alone has none. A null text is empty; a very long one is one segment. Null turns come first;
    messages with the same turn are in the order of speaker and of the md5 of their text; repeated
    messages are repeated. A null conv_id is one dialogue. An empty table
    gives an empty result.
    """
    speaker = F.coalesce(F.col("role").cast("string"), F.lit("unknown"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = turns.select("conv_id", F.col("turn").cast("bigint").alias("turn"), speaker.alias("speaker"), text.alias("text"), F.md5(text).alias("h"))
    rows = rows.groupBy("conv_id", "turn", "speaker", "h").agg(F.count("*").alias("copies"), F.min("text").alias("text"))
    rows = materialise(rows.withColumn("dialogue", F.concat_ws(":", F.lit("c"), F.col("conv_id").cast("string"))), "messages")
    people, total = materialise(casts(rows.select("dialogue", "speaker")), "people"), rows.count()
    seen = with_perspectives(with_names(rows, people, total), people, total).drop("dialogue")
    own = F.col("speaker") == F.col("perspective")
    head = F.when(own, F.lit("<|assistant|>\n")).when(F.col("speaker") == SYSTEM, F.lit("<|system|>\n")).otherwise(F.concat(F.lit("<|user name="), "name", F.lit("|>\n")))
    seen = seen.withColumns({"segment": F.concat(head, escaped(F.col("text")), F.lit(END)), "head": F.char_length(head).cast("bigint"), "own": own})
    seen = seen.drop("text", "name").withColumn("n", F.char_length("segment").cast("bigint")).withColumn("chunk", F.coalesce(F.floor(F.col("turn") / chunk), F.lit(-(2**62)))).withColumn("slot", F.substring("h", 1, 2))
    key, inner, zero = ["conv_id", "perspective", "chunk"], ["turn", "speaker", "slot"], F.lit(0)
    fine = seen.groupBy(*key, *inner).agg(F.sum(F.col("n") * F.col("copies")).alias("chars"), F.sum("copies").alias("count"))
    coarse = fine.groupBy(*key).agg(F.sum("chars").alias("chars"), F.sum("count").alias("count"))

    def before(rows: DataFrame, by: list[str], order: list, name: str, keep: list[str]) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return rows.select(*[F.col(c).alias(f"{name}_{c}") for c in keep], *[F.coalesce(F.sum(c).over(w), zero).alias(f"{name}_{c}") for c in ("chars", "count")])

    in_turns = [F.col("turn").asc_nulls_first(), "speaker", "slot"]
    a = before(coarse, key[:2], ["chunk"], "a", key)
    b = before(fine, key, in_turns, "b", key + inner)
    within = Window.partitionBy(*key, *inner).orderBy("h").rowsBetween(Window.unboundedPreceding, -1)
    placed = seen.withColumns({"at": F.coalesce(F.sum(F.col("n") * F.col("copies")).over(within), zero), "nth": F.coalesce(F.sum("copies").over(within), zero)})
    offsets = b.join(a, [F.col(f"b_{c}").eqNullSafe(F.col(f"a_{c}")) for c in key])
    placed = placed.join(offsets, [F.col(c).eqNullSafe(F.col(f"b_{c}")) for c in key + inner])
    placed = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    start = F.col("a_chars") + F.col("b_chars") + F.col("at") + F.col("copy") * F.col("n")
    end = start + F.col("n")
    seq = F.col("a_count") + F.col("b_count") + F.col("nth") + F.col("copy")
    return placed.select(
        "conv_id", "perspective", seq.alias("seq"), "turn", "speaker", "segment", start.alias("start"), end.alias("end"),
        F.when(F.col("own"), start + F.col("head")).otherwise(end).alias("mask_start"), F.when(F.col("own"), end - F.lit(1)).otherwise(end).alias("mask_end"),
    )
