"""Chat formatting by schema fingerprints.

A record is a JSON object in some layout.  The set of its nested field paths
(array places written ``[]``), as far as a mapping looks at them, is hashed to a
fingerprint, and the fingerprint selects the declarative mapping that says which
paths hold the turns.  Mapped
records become canonical turns ``(role, text)`` and one formatted string.

The template opens and closes every turn with control strings.  A control
string inside a text is escaped by a backslash after its first character, and
one that already has backslashes there gets one more, so unescaping is exact
and no text can open or close a turn.  The loss mask lists the character spans
of the assistant texts in the formatted string.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import combinations, product

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tastemap.llm.common import prepare, table

#: Control strings that open and close the turns of a role; any other role is written out.
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER = ("[ROLE]", "[AS]", "[/ROLE]")
CONTROLS = tuple(c for pair in MARKS.values() for c in pair) + OTHER
_RESTS = "|".join(re.escape(c[1:]) for c in sorted(CONTROLS, key=len, reverse=True))
_TO_ESCAPE = re.compile(rf"([<\[])(?=\\*(?:{_RESTS}))")
_ESCAPED = re.compile(rf"([<\[])\\(?=\\*(?:{_RESTS}))")
_CONTROL = re.compile("|".join(re.escape(c) for c in sorted(CONTROLS, key=len, reverse=True)))

#: Mappings by the field paths of a layout: either a list of turns with the places of role and
#: text and the names of the roles, or fixed fields, each with its role, in order.  A record fits
#: if it has all paths that the mapping ``needs`` and one of each set of ``forms``; what it ``may``
#: have is mapped as well, and any other field is left aside.
LAYOUTS = {
    "messages": {"needs": ("messages[].role",), "forms": (("messages[].content", "messages[].content[]", "messages[].content[].text"),),
                 "turns": "messages", "role": "role", "text": "content", "names": {}},
    "conversations": {"needs": ("conversations[].from", "conversations[].value"),
                      "turns": "conversations", "role": "from", "text": "value",
                      "names": {"human": "user", "gpt": "assistant"}},
    "prompt": {"needs": ("prompt", "response"),
               "fields": (("prompt", "user"), ("response", "assistant"))},
    "instruction": {"needs": ("input", "instruction", "output"),
                    "fields": (("instruction", "system"), ("input", "user"), ("output", "assistant"))},
    "bare_instruction": {"needs": ("instruction", "output"),
                         "fields": (("instruction", "user"), ("output", "assistant"))},
    "nested": {"needs": ("dialog.turns[].speaker.role", "dialog.turns[].utterance"),
               "turns": "dialog.turns", "role": "speaker.role", "text": "utterance", "names": {}},
}


def field_paths(value) -> set[str]:
    """The nested field paths of a JSON value; places of an array are not told apart.  Any depth will do."""
    paths, waiting = set(), [("", value)]
    while waiting:
        at, value = waiting.pop()
        if isinstance(value, dict) and value:
            waiting += [(f"{at}.{k}" if at else k, v) for k, v in value.items()]
        elif isinstance(value, list) and value:
            waiting += [(f"{at}[]", v) for v in value]
        else:
            paths.add(f"{at}[]" if isinstance(value, list) else at)
    return paths


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode("utf-8", "surrogatepass")).hexdigest()[:16]


def registry(layouts: dict) -> list[tuple[str, dict, frozenset, set[str]]]:
    """Each mapping with the paths that it looks at and the fingerprints of the sets of them that it takes; a list of
    turns may also be empty."""
    out = []
    for name, layout in layouts.items():
        forms = layout.get("forms", ())
        seen = frozenset(layout["needs"]).union(*forms, [f"{layout['turns']}[]"] if "turns" in layout else [])
        choices = [[subset for n in range(1, len(form) + 1) for subset in combinations(form, n)] for form in forms]
        taken = {fingerprint({*layout["needs"], *(p for subset in chosen for p in subset)}) for chosen in product(*choices)}
        if "turns" in layout:
            taken.add(fingerprint({f"{layout['turns']}[]"}))
        out.append((name, layout, seen, taken))
    return out


def mapping_of(record, known: list) -> tuple[str | None, dict | None]:
    """The first mapping that takes the fingerprint of those paths of a record that it looks at."""
    paths = field_paths(record)
    for name, layout, seen, taken in known:
        if fingerprint(paths & seen) in taken:
            return name, layout
    return None, None


def _get(value, path: str):
    for key in path.split("."):
        value = value.get(key) if isinstance(value, dict) else None
    return value


_SURROGATE = re.compile("[\ud800-\udfff]")


def _word(value) -> str:
    """The text of a field: parts of a list (texts, or objects with a ``text``) in order, anything else as JSON;
    lone surrogates, which no encoding has, are U+FFFD."""
    if isinstance(value, list) and all(isinstance(v, str) or isinstance(v, dict) and isinstance(v.get("text", ""), str) for v in value):
        value = "".join(v if isinstance(v, str) else v.get("text", "") for v in value)
    text = "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
    return _SURROGATE.sub("\ufffd", text)


def canonical_turns(record, layout: dict) -> list[tuple[str, str]]:
    if "fields" in layout:
        return [(role, _word(_get(record, field))) for field, role in layout["fields"]]
    turns = []
    for turn in _get(record, layout["turns"]) or []:
        role = _word(_get(turn, layout["role"]))
        turns.append((layout["names"].get(role, role), _word(_get(turn, layout["text"]))))
    return turns


def escape(text: str) -> str:
    return _TO_ESCAPE.sub(r"\1\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted string and the spans of the assistant texts in it."""
    parts, at, spans = [], 0, []
    for role, text in turns:
        opening, closing = MARKS.get(role) or (f"{OTHER[0]}{escape(role)}{OTHER[1]}", OTHER[2])
        body = escape(text)
        if role == "assistant":
            spans.append((at + len(opening), at + len(opening) + len(body)))
        parts += [opening, body, closing]
        at += len(opening) + len(body) + len(closing)
    return "".join(parts), spans


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted string, by its control strings alone."""
    roles = {opening: role for role, (opening, _) in MARKS.items()}
    turns, role, start = [], "", 0
    for m in _CONTROL.finditer(formatted):
        mark = m[0]
        if mark == OTHER[1]:
            role = unescape(formatted[start:m.start()])
        elif mark in roles:
            role = roles[mark]
        elif mark != OTHER[0]:
            turns.append((role, unescape(formatted[start:m.start()])))
        start = m.end()
    return turns


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_SPANS_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def format_chats(records: DataFrame, *, record_id: str, payload: str, layouts: dict | None = None) -> DataFrame:
    """One row per record: ``conv_id, layout, n_turns, formatted, loss_spans``.

    ``payload`` is a JSON string.  A record may have fields that its mapping does
    not know.  One that is null, not a JSON object, nested too deeply to be read
    or of an unknown layout keeps its row, with a null ``layout``, no turns and an
    empty string, so it can be counted and mapped later.  A null role or text
    is empty; a role without marks is written out.  Repeated and empty records
    are kept, other columns ignored; an empty table gives no rows.
    """
    prepare(records.sparkSession)
    known = registry(layouts or LAYOUTS)
    source = records.select(F.col(record_id).alias("conv_id"), F.col(payload).alias("_tm_payload"))
    out = T.StructType([
        source.schema["conv_id"], T.StructField("layout", T.StringType()), T.StructField("n_turns", T.LongType()),
        T.StructField("formatted", T.StringType()), T.StructField("loss_spans", _SPANS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, counts, texts, masks = [], [], [], []
            for raw in batch.column("_tm_payload").to_pylist():
                try:
                    record = json.loads(raw) if raw is not None else None
                except (ValueError, RecursionError):
                    record = None
                name, layout = mapping_of(record, known) if isinstance(record, dict) else (None, None)
                try:
                    turns = canonical_turns(record, layout) if layout else []
                except RecursionError:  # a text that is itself a value nested without end
                    name, turns = None, []
                text, spans = render(turns)
                names.append(name)
                counts.append(len(turns))
                texts.append(text)
                masks.append([{"start": s, "end": e} for s, e in spans])
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), pa.array(names, pa.string()), pa.array(counts, pa.int64()),
                 pa.array(texts, pa.string()), pa.array(masks, _SPANS_ARROW)], names=[f.name for f in out])

    return source.mapInArrow(run, out)


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted strings say, read back from them: ``conv_id, n_turns,
    turns_sha256, loss_chars, loss_sha256, formatted_chars``."""
    out = T.StructType([
        formatted.schema["conv_id"], T.StructField("n_turns", T.LongType()),
        T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()),
        T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column("formatted").to_pylist(), batch.column("loss_spans").to_pylist(),
                                   strict=True):
                turns = read_back(text)
                said = "".join(f"{role}\n{body}\n" for role, body in turns)
                loss = "".join(unescape(text[s["start"]:s["end"]]) for s in spans)
                rows.append((len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss),
                             hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"),
                 *(pa.array(c, pa.string() if i in (1, 3) else pa.int64()) for i, c in enumerate(columns))],
                names=[f.name for f in out])

    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(run, out)


def as_records(turns: DataFrame) -> DataFrame:
    """Row-per-turn conversations as one JSON record each (``conv_id, payload``).

    Turns are ordered by ``turn``, then role and text (nulls first).  A
    conversation is written in the layout that its turns fit: prompt and
    response, instruction, input and output, and otherwise by its id in one of
    the three message layouts (only the plain one takes unusual roles).
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
                        F.coalesce("text", F.lit("")).alias("text"))
    grouped = rows.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    shape = F.concat_ws(",", "t.role")
    usual = F.forall("t", lambda x: x["role"].isin(*MARKS))
    kind = F.pmod(F.xxhash64("conv_id"), F.lit(3))

    def text(i):
        return F.col("t")[i]["text"]

    def listed(outer, item):
        return F.to_json(F.struct(F.transform("t", item).alias(outer)))

    names = F.create_map(*(F.lit(x) for x in ("user", "human", "assistant", "gpt", "system", "system")))
    return grouped.select("conv_id", (
        F.when(shape == "user,assistant", F.to_json(F.struct(text(0).alias("prompt"), text(1).alias("response"))))
        .when(shape == "system,user,assistant",
              F.to_json(F.struct(text(0).alias("instruction"), text(1).alias("input"), text(2).alias("output"))))
        .when(usual & (kind == 0),
              listed("conversations", lambda x: F.struct(names[x["role"]].alias("from"), x["text"].alias("value"))))
        .when(usual & (kind == 1), F.to_json(F.struct(F.struct(F.transform(
            "t", lambda x: F.struct(F.struct(x["role"].alias("role")).alias("speaker"), x["text"].alias("utterance"))
        ).alias("turns")).alias("dialog"))))
        .otherwise(listed("messages", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))))
    ).alias("payload"))


#: The conversation that the contract adds: both texts hold control strings.
ADDED = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op10_chat_format(spark, sf_dir):
    """All of ``conversations`` and conversation -7."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame(ADDED, "conv_id long, turn long, role string, text string")
    return digests(format_chats(as_records(rows.unionByName(added)), record_id="conv_id", payload="payload"))


OP10_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
f AS (SELECT *, length(text) + len(regexp_extract_all(text,
        '[<\[]\\*(<SYS>>|</SYS>>|INST\]|/INST\]|s>|/s>|ROLE\]|AS\]|/ROLE\])'))
      + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 17 + length(role) END AS chars
      FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""
