"""Chat formatting: typed content parts flattened into one marked-up text per conversation.

A turn's content is an array of typed parts. A visitor (one Column expression per part type, see ``VISITORS``) turns each
part into text: a text part into its escaped text, an image, audio or document part into a placeholder that carries the
part's position among the conversation's attachments. Beside the text the operator returns the attachments, in the order
of their placeholders, each with its reference and the number of tokens that it expands to.

The template::

    <|im_start|>ROLE<|im_sep|>PARTS<|im_end|>

Control strings begin with ``<|``. Inside roles and texts a backslash becomes two and ``<|`` becomes ``<\\|``; after that
no text holds ``<|``, and every backslash opens one of two escapes, so ``unescape`` gives back any text exactly.

The loss mask is an array of spans (start, length in code points, from 0): all parts of assistant turns, without marks. A
span also says in which turn it lies (from 1) and where in it (from behind its first mark), so that it is found without
counting through the whole text.

Everything is built-in functions. The one shuffle deals turns out by conversation; where a turn's text and its attachments
begin are running sums over its conversation's turns, so the work is linear in them. The turns of one conversation meet in
one row because its formatted text is one value, so a conversation must fit in a row (2 GB), as in any table that holds it.

Results by definition: a null text, part array or role counts as empty; rows whose conversation id is null form one
conversation; turns stand in order of turn (null first), then role, then text, so ties and repeated rows have a fixed
order and all stay; part types other than the four are an error; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
PART_TYPE = "struct<kind:string,text:string,ref:string,width:int,height:int,millis:bigint,pages:int>"
PATCH_PIXELS = 28
AUDIO_TOKEN_MILLIS = 40
PAGE_TOKENS = 256


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _patches(pixels: Column) -> Column:
    return F.ceil(F.coalesce(pixels, F.lit(0)).cast("double") / PATCH_PIXELS).cast("long")


#: Kind of part -> tokens that it expands to. Text parts are counted by the tokenizer, not here.
VISITORS = {
    "image": lambda p: _patches(p["width"]) * _patches(p["height"]),
    "audio": lambda p: F.ceil(F.coalesce(p["millis"], F.lit(0)).cast("double") / AUDIO_TOKEN_MILLIS).cast("long"),
    "document": lambda p: (F.coalesce(p["pages"], F.lit(0)) * PAGE_TOKENS).cast("long"),
}


def _choose(kind: Column, cases: dict[str, Column]) -> Column:
    out = F.raise_error(F.concat(F.lit("unknown kind of part: "), F.coalesce(kind, F.lit("null")))).cast("string")
    for name, value in cases.items():
        out = F.when(kind == name, value).otherwise(out)
    return out


def text_part(text: Column) -> Column:
    """An array of one text part."""
    nothing = {"ref": "string", "width": "int", "height": "int", "millis": "bigint", "pages": "int"}
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(text.cast("string"), F.lit("")).alias("text"), *(F.lit(None).cast(t).alias(c) for c, t in nothing.items())))


def format_chat(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans, attachments, expanded_tokens.

    ``parts`` is a column of ``array<PART_TYPE>``. Attachments are structs (ordinal, kind, ref, n_tokens).
    """
    typed = f"array<{PART_TYPE}>"
    rows = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(parts), F.array().cast(typed)).cast(typed).alias("parts"))
    media = lambda p: p["kind"] != "text"
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "parts")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    # attachments before each turn: where its first placeholder's ordinal begins
    rows = rows.withColumn("media", F.filter("parts", media)).withColumns({"place": F.row_number().over(order), "base": F.coalesce(F.sum(F.size("media")).over(before), F.lit(0))})

    def body(places: Column) -> Column:
        mark = lambda k, j: F.concat(F.lit(f"<|{k}:"), (F.col("base") + F.array_position(places, j) - 1).cast("string"), F.lit("|>"))
        seen = lambda p, j: _choose(p["kind"], {"text": escape(F.coalesce(p["text"], F.lit("")))} | {k: mark(k, j) for k in VISITORS})
        return F.array_join(F.transform("parts", seen), "")

    places = F.filter(F.transform("parts", lambda p, j: F.when(media(p), j)), lambda j: j.isNotNull())
    rows = rows.withColumns({"head": F.concat(F.lit(START), escape(F.col("role")), F.lit(SEP)), "body": _bound(places, body)})
    tokens = lambda p: _choose(p["kind"], {k: f(p).cast("string") for k, f in VISITORS.items()}).cast("long")
    rows = rows.select(
        "conv_id", "place", F.concat("head", "body", F.lit(END)).alias("piece"), (F.col("role") == "assistant").alias("loss"), (F.length("head") - len(START)).alias("offset"), F.length("body").cast("long").alias("length"),
        F.transform("media", lambda p, j: F.struct((F.col("base") + j).cast("int").alias("ordinal"), p["kind"].alias("kind"), p["ref"].alias("ref"), tokens(p).alias("n_tokens"))).alias("media"),
    )
    rows = rows.withColumn("start", F.coalesce(F.sum(F.length("piece").cast("long")).over(Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("offset") + len(START))
    talks = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", "piece", "loss", "start", "length", "offset", "media"))).alias("turns"))
    span = lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length"), t["place"].alias("turn"), t["offset"].alias("offset"))
    return talks.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["loss"]), span).alias("loss_spans"),
        F.flatten(F.transform("turns", lambda t: t["media"])).alias("attachments"),
        F.aggregate(F.flatten(F.transform("turns", lambda t: t["media"])), F.lit(0).cast("long"), lambda n, a: n + a["n_tokens"]).alias("expanded_tokens"),
    )


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, also where it stands inside a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted text: an array of structs (role, text), unescaped; placeholders stand as they are."""
    parts = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda _, i: i > 0)

    def turn(piece: Column) -> Column:
        ends = F.split(F.substring_index(piece, END, 1), r"<\|im_sep\|>")
        return F.struct(unescape(ends[0]).alias("role"), unescape(ends[1]).alias("text"))

    return F.transform(parts, turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between. The text is cut at its turns once; a span says which is its own."""
    said = lambda pieces: F.transform(spans, lambda s: unescape(F.substring(F.get(pieces, s["turn"].cast("int")), s["offset"].cast("int") + 1, s["length"].cast("int"))))
    return F.array_join(_bound(F.split(formatted, r"<\|im_start\|>"), said), "")
