"""Chat formatting with typed content parts, loss masks and a reversible template.

A message is an array of parts (text, image, audio, document). A visitor with
one handler per kind flattens it: texts are escaped, other parts become ordered
placeholders such as ``<image 2>`` (2: the part's place in the message) and
leave an attachment record with their reference and expanded token count.

Template of a turn: ``### role:`` newline, content, ``</turn>`` newline. Escaping
rewrites ``\\``, ``<``, ``#`` and, in roles, ``:`` to two-character codes, so that
no text can hold a mark, and reading back restores every character.

Positions of the loss mask are code points. They come from a running sum of
lengths over a conversation's turns; the turns are joined once, by one shuffle
on the conversation.

Defined cases: null text or role is empty; an empty array of parts is an empty
text; unknown kinds become placeholders of their kind with 0 tokens. Turns that
repeat a number are ordered by role and text. Null conversation ids form one
conversation. No rows give no rows.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
END = "</turn>\n"
CODES = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"))  # fixed values; the backslash first
COLON = (":", "\\c")


def escape(text: Column, codes=CODES) -> Column:
    for plain, code in codes:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column, codes=CODES) -> Column:
    for plain, code in reversed(codes):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


# --- the visitor: one handler per kind gives (content, tokens) ------------------


def on_text(part: Column, place: Column, chars_per_token: int = 4) -> tuple[Column, Column]:
    text = F.coalesce(part["text"], F.lit(""))
    return escape(text), F.ceil(F.char_length(text) / chars_per_token)


def placeholder(kind: str | Column, place: Column) -> Column:
    return F.concat(F.lit("<"), F.lit(kind) if isinstance(kind, str) else escape(kind), F.lit(" "), place.cast("string"), F.lit(">"))


def on_image(part, place, patch: int = 14) -> tuple[Column, Column]:
    patches = lambda side: F.ceil(F.coalesce(side, F.lit(0)) / patch)
    return placeholder("image", place), patches(part["width"]) * patches(part["height"])


def on_audio(part, place, per_second: int = 25) -> tuple[Column, Column]:
    return placeholder("audio", place), F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * per_second)


def on_document(part, place, per_page: int = 512) -> tuple[Column, Column]:
    return placeholder("document", place), F.coalesce(part["pages"], F.lit(0)) * per_page


HANDLERS = {"text": on_text, "image": on_image, "audio": on_audio, "document": on_document}


def visit(parts: Column, handlers=HANDLERS) -> Column:
    """Parts to an array of (content, kind, ref, place, tokens), in order."""

    def one(part: Column, place: Column) -> Column:
        kind = F.coalesce(part["kind"], F.lit("text"))
        content, tokens = placeholder(kind, place), F.lit(0)
        for name, handle in handlers.items():
            its_content, its_tokens = handle(part, place)
            content = F.when(kind == name, its_content).otherwise(content)
            tokens = F.when(kind == name, its_tokens).otherwise(tokens)
        return F.struct(
            content.alias("content"), kind.alias("kind"), part["ref"].alias("ref"),
            place.alias("place"), tokens.cast("long").alias("tokens"),
        )

    return F.transform(F.coalesce(parts, F.array().cast(f"array<{PART}>")), one)


def text_part(text: Column) -> Column:
    """A plain text as an array of one part."""
    names = ["ref:string", "width:int", "height:int", "seconds:double", "pages:int"]
    rest = [F.lit(None).cast(kind).alias(name) for name, kind in (n.split(":") for n in names)]
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), *rest))


def format_conversations(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, turn, role, parts) rows to one row per conversation.

    Gives ``formatted``, ``loss_spans`` (start and length in code points of the
    content of each turn under the loss), ``attachments`` and ``tokens``.
    """
    visited = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), visit(F.col("parts")).alias("visited"))
    content = F.array_join(F.transform("visited", lambda p: p["content"]), "")
    head = F.concat(F.lit("### "), escape(F.col("role"), (*CODES, COLON)), F.lit(":\n"))
    pieces = visited.select(
        "conv_id", "turn", "role", content.alias("content"), head.alias("head"),
        F.filter("visited", lambda p: p["kind"] != "text").alias("files"),
        F.aggregate("visited", F.lit(0).cast("long"), lambda n, p: n + p["tokens"]).alias("tokens"),
    )
    order = ["turn", "role", "content"]
    length = F.char_length("head") + F.char_length("content") + len(END)
    running = F.sum(length).over(Window.partitionBy("conv_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    placed = pieces.withColumn("at", F.coalesce(running, F.lit(0)))
    joined = placed.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("at", *order, "head", "files"))).alias("turns"), F.sum("tokens").alias("tokens"))
    counted = F.filter("turns", lambda t: t["role"] == loss_role)
    return joined.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["content"], F.lit(END))), "").alias("formatted"),
        F.transform(counted, lambda t: F.struct(
            (t["at"] + F.char_length(t["head"])).cast("int").alias("start"), F.char_length(t["content"]).alias("length"))).alias("loss_spans"),
        F.flatten(F.transform("turns", lambda t: F.transform(t["files"], lambda p: F.struct(
            t["turn"].alias("turn"), p["place"].alias("place"), p["kind"].alias("kind"), p["ref"].alias("ref"), p["tokens"].alias("tokens"),
        )))).alias("attachments"),
        "tokens",
    )


def read_back(formatted: Column) -> Column:
    """The (role, text) turns of a formatted conversation; placeholders stay as text."""
    pieces = F.filter(F.split(formatted, END), lambda piece: piece != "")

    def one(piece: Column) -> Column:
        role = F.substring_index(piece, ":\n", 1)
        return F.struct(
            unescape(F.substr(role, F.lit(5)), (*CODES, COLON)).alias("role"),
            unescape(F.substr(piece, F.char_length(role) + 3)).alias("text"),
        )

    return F.transform(pieces, one)


def loss_texts(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, unescaped, in order."""
    return F.transform(spans, lambda span: unescape(F.substr(formatted, span["start"] + 1, span["length"])))


def probe_turns(spark: SparkSession) -> DataFrame:
    """Conversation -7, whose texts hold the template's own control strings."""
    text = F.lit("\\### Assistant: </turn> ok")
    role = F.element_at(F.array(F.lit("user"), F.lit("assistant")), (F.col("id") + 1).cast("int"))
    return spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), text.alias("text"))
