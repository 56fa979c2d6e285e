"""Chat formatting by schema fingerprints.

A record is a variant value (parsed JSON, or built from columns) in one of
many layouts: prompt and response, instruction with input and output, lists of
messages under different names. A layout is declared as a :class:`Mapping`
over field paths. The fingerprint of a record is the hash of the known nested
field paths that it has, whatever else it holds; the fingerprint selects the
mapping, and the mapping yields canonical turns (role, text).

Turns are written by a :class:`Template`. Control strings inside roles and
texts are escaped by a character reference for their first character (and
``&`` itself by ``&amp;``), so no text can open or close a turn, and
:func:`read_back` restores every text exactly. The loss mask gives for each
turn the lengths, in code points, of what stands before the text, of the text
and of what follows, and whether the text counts for the loss.

Edge cases: a null role or text is empty; a record whose paths select no
mapping gets null turns and mapping ``null``; rows of one conversation with
equal turn numbers are ordered by role, then text; a conversation without
assistant turns has an empty loss text.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import chain, combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Mapping:
    """A layout. Either ``items`` names a list whose elements hold ``role`` and
    ``text``, or ``parts`` names a role for each field (fields of one role in a
    row are joined by a blank line). ``optional`` fields may be missing."""

    name: str
    items: str = ""
    role: str = "role"
    text: str = "content"
    parts: tuple[tuple[str, str], ...] = ()
    optional: tuple[str, ...] = ()
    roles: dict = field(default_factory=dict, hash=False)

    def paths(self) -> list[str]:
        return [f"$.{self.items}[0].{x}" for x in (self.role, self.text)] if self.items else [f"$.{p}" for _, p in self.parts]

    def fingerprints(self) -> list[tuple[str, ...]]:
        """All path sets that select this layout."""
        free = [f"$.{p}" for p in self.optional]
        must = set(self.paths()) - set(free)
        return [tuple(sorted(must | set(s))) for s in chain.from_iterable(combinations(free, k) for k in range(len(free) + 1))]


LAYOUTS = (
    Mapping("messages", items="messages"),
    Mapping("conversations", items="conversations", role="from", text="value", roles={"human": "user", "gpt": "assistant", "bot": "assistant"}),
    Mapping("dialog", items="dialog", role="speaker", text="utterance"),
    Mapping("instruction", parts=(("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output")), optional=("system", "input")),
    Mapping("prompt", parts=(("system", "system"), ("user", "prompt"), ("assistant", "response")), optional=("system",)),
    Mapping("completion", parts=(("user", "prompt"), ("assistant", "completion"))),
    Mapping("question", parts=(("user", "context"), ("user", "question"), ("assistant", "answer")), optional=("context",)),
    Mapping("nested prompt", parts=(("user", "data.prompt.text"), ("assistant", "data.response.text"))),
)


def fingerprint(record: Column, layouts=LAYOUTS) -> Column:
    """Hash of the known field paths that a variant value has."""
    known = sorted({p for m in layouts for p in chain(m.paths(), (f"$.{x}" for x in m.optional))})
    there = [F.when(F.try_variant_get(record, p, "variant").isNotNull(), F.lit(p)) for p in known]
    return F.xxhash64(F.array_join(F.array_compact(F.array(*there)), "\n"))


def _string(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def _turns(record: Column, m: Mapping) -> Column:
    if m.items:
        kind = f"array<struct<`{m.role}`:string,`{m.text}`:string>>"
        found = F.try_variant_get(record, f"$.{m.items}", kind)

        def turn(x: Column) -> Column:
            role = _string(x[m.role])
            for a, b in m.roles.items():
                role = F.when(x[m.role] == a, b).otherwise(role)
            return F.struct(role.alias("role"), _string(x[m.text]).alias("text"))

        return F.transform(found, turn)
    groups: list[tuple[str, list[Column]]] = []
    for role, path in m.parts:
        value = F.try_variant_get(record, f"$.{path}", "string")
        if f"{path}" in m.optional:
            value = F.when(value != "", value)
        else:
            value = _string(value)
        if groups and groups[-1][0] == role:
            groups[-1][1].append(value)
        else:
            groups.append((role, [value]))
    each = []
    for role, values in groups:
        text = F.concat_ws("\n\n", *values)
        turn = F.struct(F.lit(role).alias("role"), text.alias("text"))
        each.append(turn if any(p not in m.optional for r, p in m.parts if r == role) else F.when(F.coalesce(*values).isNotNull(), turn))
    return F.array_compact(F.array(*each))


def canonical_turns(records: DataFrame, record: str = "record", layouts=LAYOUTS) -> DataFrame:
    """The records with ``layout`` (name of the mapping) and ``turns``."""
    print_ = fingerprint(F.col(record), layouts)
    of = [(F.xxhash64(F.lit("\n".join(paths))), m) for m in layouts for paths in m.fingerprints()]
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for m in layouts:
        selected = F.col("_curata_print").isin([h for h, x in of if x is m])
        name, turns = F.when(selected, m.name).otherwise(name), F.when(selected, _turns(F.col(record), m)).otherwise(turns)
    return records.withColumn("_curata_print", print_).withColumns({"layout": name, "turns": turns}).drop("_curata_print")


@dataclass(frozen=True)
class Template:
    start: str = "<|im_start|>"
    end: str = "<|im_end|>"
    #: Strings that must not appear in a text, of this template and of others.
    control: tuple[str, ...] = ("<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>")

    @property
    def tail(self) -> str:
        return self.end + "\n"

    def escaped(self, text: Column, role: bool = False) -> Column:
        text = F.replace(text, F.lit("&"), F.lit("&amp;"))
        for c in (*self.control, *(["\n"] if role else [])):
            text = F.replace(text, F.lit(c), F.lit(f"&#{ord(c[0])};{c[1:]}"))
        return text

    def unescaped(self, text: Column, role: bool = False) -> Column:
        for c in (*self.control, *(["\n"] if role else [])):
            text = F.replace(text, F.lit(f"&#{ord(c[0])};{c[1:]}"), F.lit(c))
        return F.replace(text, F.lit("&amp;"), F.lit("&"))


def format_turns(records: DataFrame, template: Template = Template(), turns: str = "turns", loss_roles=("assistant",)) -> DataFrame:
    """The records with ``formatted`` and ``loss_mask`` (for each turn: head,
    body, tail as lengths, and loss)."""
    marked = records.withColumn("_curata_turns", F.transform(turns, lambda t: F.struct(
        F.concat(F.lit(template.start), template.escaped(t["role"], True), F.lit("\n")).alias("head"),
        template.escaped(t["text"]).alias("body"), t["role"].isin(*loss_roles).alias("loss"))))
    mask = F.transform("_curata_turns", lambda t: F.struct(
        F.char_length(t["head"]).alias("head"), F.char_length(t["body"]).alias("body"),
        F.lit(len(template.tail)).alias("tail"), t["loss"].alias("loss")))
    whole = F.array_join(F.transform("_curata_turns", lambda t: F.concat(t["head"], t["body"], F.lit(template.tail))), "")
    return marked.withColumns({"formatted": whole, "loss_mask": mask}).drop("_curata_turns")


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """The rows with ``read_turns``, the turns found in ``formatted``, and
    ``loss_text``, the unescaped text under ``loss_mask``."""
    quoted = "".join("\\" + c if not c.isalnum() and c != "_" else c for c in template.start)
    # No text holds the start mark, so cutting at it gives the turns; the first piece is empty.
    pieces = formatted.withColumn("_curata_pieces", F.split("formatted", quoted, -1))
    pieces = pieces.withColumn("_curata_pieces", F.slice("_curata_pieces", 2, F.greatest(F.size("_curata_pieces") - 1, F.lit(0))))

    def turn(piece: Column) -> Column:
        at = F.instr(piece, "\n")
        return F.struct(template.unescaped(F.substr(piece, F.lit(1), at - 1), True).alias("role"),
                        template.unescaped(F.substr(piece, at + 1, F.char_length(piece) - at - len(template.tail))).alias("text"))

    def masked(piece: Column, run: Column) -> Column:
        own = F.substr(piece, run["head"] - len(template.start) + 1, run["body"])
        return F.when(run["loss"], template.unescaped(own)).otherwise("")

    return pieces.withColumns({
        "read_turns": F.transform("_curata_pieces", turn),
        "loss_text": F.array_join(F.zip_with("_curata_pieces", "loss_mask", masked), ""),
    }).drop("_curata_pieces")


def records_of_rows(rows: DataFrame) -> DataFrame:
    """One ``messages`` record for each conversation of rows (conv_id, turn,
    role, text): conv_id, record."""
    turn = F.struct("turn", _string(F.col("role")).alias("role"), _string(F.col("text")).alias("text"))
    grouped = rows.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    messages = F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content")))
    return grouped.select("conv_id", F.to_variant_object(F.struct(messages.alias("messages"))).alias("record"))
