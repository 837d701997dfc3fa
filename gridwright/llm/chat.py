"""Chat formatting by a grammar round trip, in DataFrame functions only.

Grammar of a formatted conversation (every control string is one of ``CONTROLS``)::

    conversation := turn*
    turn         := '<s>[INST] ' header '\\n' body ' [/INST]'      any role but assistant
                  | '<s>' header '\\n' body '</s>'                 assistant
    header       := role | role '\\'                               a trailing backslash: escaped

Body and header hold no control string, so the language is deterministic: the
reader takes the next closing control and never has to go back.  A turn is
first rendered as it is and read again between two neighbours; where what comes
back differs (a control string in the text, a role with a line break, ...) it is
rendered escaped, its role as hexadecimal UTF-8.  Escaping doubles backslashes and puts one after the first
character of a control string, which is undone by dropping the backslash before
any character.  The finished conversation is parsed as a whole once more; if any
turn still differs, all of its turns are escaped.

Null text and null role count as empty; a null conv_id forms a conversation of
its own; null turns come first; equal rows are kept, each as a turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The control strings of the template.
CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]"]
_CONTROL = r"<s>|</s>|\[INST\]|\[/INST\]"
#: One turn.  Groups: 1, 2 header and body of a prompt turn; 3, 4 of an assistant turn.
TURN = r"(?s)<s>\[INST\] ([^\n]*)\n(.*?) \[/INST\]|<s>([^\n]*)\n(.*?)</s>"


def escape(c: Column) -> Column:
    doubled = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, r"(<(?=/?s>)|\[(?=/?INST\]))", r"$1\\")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def _escape_role(c: Column) -> Column:
    """Roles stand on one line and may hold anything: hexadecimal UTF-8."""
    return F.hex(F.encode(c, "UTF-8"))


def _unescape_role(c: Column) -> Column:
    return F.decode(F.unhex(c), "UTF-8")


def render(role: Column, text: Column, escaped: Column) -> Column:
    head = F.when(escaped, F.concat(_escape_role(role), F.lit("\\"))).otherwise(role)
    body = F.when(escaped, escape(text)).otherwise(text)
    return F.when(role == "assistant", F.concat(F.lit("<s>"), head, F.lit("\n"), body, F.lit("</s>"))).otherwise(
        F.concat(F.lit("<s>[INST] "), head, F.lit("\n"), body, F.lit(" [/INST]"))
    )


def parse(formatted: Column) -> Column:
    """array<struct<role, text, loss>> read back from formatted text; null if anything is left over."""
    full = F.regexp_extract_all(formatted, F.lit(TURN), F.lit(0))

    seg = F.transform(
        full,
        lambda x: F.struct(
            x.startswith("<s>[INST] ").alias("prompt"),
            F.when(x.startswith("<s>[INST] "), F.substr(x, F.lit(11), F.length(x) - 18))
            .otherwise(F.substr(x, F.lit(4), F.length(x) - 7))
            .alias("inner"),
        ),
    )

    def turn(s: Column) -> Column:
        head = F.substring_index(s["inner"], "\n", 1)
        body = F.substr(s["inner"], F.length(head) + 2)
        esc = head.endswith("\\")
        plain = F.substr(head, F.lit(1), F.length(head) - 1)
        return F.struct(
            F.when(esc, _unescape_role(plain)).otherwise(head).alias("role"),
            F.when(esc, unescape(body)).otherwise(body).alias("text"),
            (~s["prompt"]).alias("loss"),
        )

    whole = F.aggregate(full, F.lit(0).cast("long"), lambda a, x: a + F.length(x)) == F.length(formatted)
    return F.when(whole, F.transform(seg, turn))


def _recovers(role: Column, text: Column, rendered: Column) -> Column:
    """Does the turn come back between two neighbours, with nothing left over?"""
    fence = F.lit("<s>[INST] a\nb [/INST]")
    got = parse(F.concat(fence, rendered, fence))
    want = F.struct(role.alias("role"), text.alias("text"), (role == "assistant").alias("loss"))
    return F.coalesce((F.size(got) == 3) & (F.get(got, F.lit(1)) == want), F.lit(False))


def format_chats(rows: DataFrame) -> DataFrame:
    """(conv_id, formatted, source_turns, spans, all_escaped) from (conv_id, turn, role, text) rows.

    ``spans`` marks the assistant bodies in ``formatted`` (start, len in code
    points, byte_start, byte_len in UTF-8, escaped): the loss mask.  Turns are rendered, probed and escaped row
    by row; only the finished pieces meet in the group of their conversation.
    """
    t = rows.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    raw = render(F.col("role"), F.col("text"), F.lit(False))
    has = F.col("text").rlike(_CONTROL) | F.col("role").rlike(_CONTROL) | F.col("role").rlike(r"[\n\\]")
    # the probe is only run where a control string or a backslash stands in the turn: nothing else can differ
    t = t.withColumn("escaped", F.when(has, ~_recovers(F.col("role"), F.col("text"), raw)).otherwise(F.lit(False)))
    t = t.withColumn("piece", render(F.col("role"), F.col("text"), F.col("escaped")))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    before = Window.partitionBy("conv_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = t.withColumn("nth", F.row_number().over(Window.partitionBy("conv_id").orderBy(*order)))
    t = t.withColumn("forced", render(F.col("role"), F.col("text"), F.lit(True)))
    tail = F.when(F.col("role") == "assistant", 4).otherwise(8)  # the closing control, in code points and bytes

    def span(piece: str, escaped: Column) -> Column:
        """Where the body stands in the conversation, if its turns are rendered as ``piece``."""
        head, size, octets = F.instr(piece, "\n"), F.length(piece), F.octet_length(piece)
        head_octets = F.octet_length(F.substr(F.col(piece), F.lit(1), head))
        return F.struct(
            (F.sum(size).over(before) - size + head).alias("start"), (size - head - tail).alias("len"),
            (F.sum(octets).over(before) - octets + head_octets).alias("byte_start"), (octets - head_octets - tail).alias("byte_len"),
            escaped.alias("escaped"),
        )

    t = t.withColumn("span", span("piece", F.col("escaped"))).withColumn("forced_span", span("forced", F.lit(True)))
    t = t.withColumn("turn_row", F.struct("nth", "role", "text", "piece", "span", "forced_span"))
    g = t.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn_row")).alias("turns"))
    want = F.transform(
        "turns", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"), (x["role"] == "assistant").alias("loss"))
    )
    g = g.withColumn("formatted", F.array_join(F.transform("turns", lambda x: x["piece"]), ""))
    g = g.withColumn("source_turns", want)
    g = g.withColumn("all_escaped", ~F.coalesce(parse(F.col("formatted")) == F.col("source_turns"), F.lit(False)))
    again = F.array_join(F.transform("turns", lambda x: render(x["role"], x["text"], F.lit(True))), "")
    own = F.filter("turns", lambda x: x["role"] == "assistant")
    spans = F.when(F.col("all_escaped"), F.transform(own, lambda x: x["forced_span"])).otherwise(F.transform(own, lambda x: x["span"]))
    return g.select(
        "conv_id",
        F.when(F.col("all_escaped"), again).otherwise(F.col("formatted")).alias("formatted"),
        "source_turns",
        spans.alias("spans"),
        "all_escaped",
    )


def masked(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, unescaped.  Cut out of the bytes: there a position is found at once, however long the conversation."""

    def text(raw: Column, s: Column) -> Column:
        body = F.decode(F.substr(raw, (s["byte_start"] + 1).cast("int"), s["byte_len"].cast("int")), "UTF-8")
        return F.when(s["escaped"], unescape(body)).otherwise(body)

    bound = F.transform(F.array(F.encode(formatted, "UTF-8")), lambda raw: F.transform(spans, lambda s: text(raw, s)))
    return F.get(bound, F.lit(0))


def digest_chats(formatted: DataFrame) -> DataFrame:
    """The contract's columns, read back from ``formatted``: the turns by the parser, the loss by the mask."""
    got = formatted.withColumn("got", parse(F.col("formatted")))
    turns = F.array_join(F.transform("got", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join(masked(F.col("formatted"), F.col("spans")), "")
    got = got.withColumn("all_turns", turns).withColumn("loss_text", loss)
    return got.select(
        "conv_id",
        F.size("got").cast("long").alias("n_turns"),
        F.sha2(F.encode("all_turns", "UTF-8"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.encode("loss_text", "UTF-8"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
