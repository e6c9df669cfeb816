"""Personal data by proposal, checksum and context, in SQL expressions alone.

Regular expressions propose spans; checksums (Luhn, mod-97) and ranges confirm
or drop them; words near a span move its score.  A proposal is reported when
its score reaches :data:`THRESHOLD`.  The four base kinds (email, ip, card,
phone) start at or above it, so context never removes them; the others need
their checksum or a word nearby.

Every pattern begins with a class of few characters and takes its runs
possessively, so a scan is linear in the text.  Positions of matches are running
sums by doubling, and parts of a text are taken from a list of its chunks, so
the work grows as n log n with the matches of a text and not with their square.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Score from which a proposal is reported.
THRESHOLD = 0.5
#: Code points on either side of a span in which words count as near.
NEAR = 48
#: Code points of a chunk.
CHUNK = 256


@dataclass(frozen=True)
class Kind:
    """``gate``: SQL on ``text`` that any match needs; ``holds``: SQL on the match ``v``; ``near``: words that raise ``score`` by ``lift``."""

    name: str
    pattern: str
    gate: str
    holds: str
    score: float
    near: str
    lift: float
    base: bool = False


_DIGITS = "regexp_replace(v, '[^0-9]', '')"
#: The last digit counts once, the one before it twice, and so on to the left.
_LUHN = f"""aggregate(transform(split(reverse({_DIGITS}), ''), (c, i) -> case when i % 2 = 0 then int(c) when int(c) > 4 then 2 * int(c) - 9 else 2 * int(c) end), 0, (a, d) -> a + coalesce(d, 0)) % 10 = 0"""
#: ISO 13616: the first four characters go last, letters count as two digits.
_MOD97 = """aggregate(split(concat(substring(replace(v, ' ', ''), 5), substring(replace(v, ' ', ''), 1, 4)), ''), 0,
    (a, c) -> case when c = '' then a when c between '0' and '9' then (a * 10 + int(c)) % 97 else (a * 100 + ascii(c) - 55) % 97 end) = 1"""

KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "contains(text, '@')", "true", 0.8, "mail|e-mail|email|contact|write", 0.2, True),
    Kind("ip", r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)", r"regexp_like(text, '[0-9]\\.[0-9]')", r"forall(split(v, '\\.'), p -> length(ltrim('0', p)) <= 3 and int(concat('0', right(ltrim('0', p), 3))) <= 255)", 0.6, "ip|host|server|address|login", 0.3, True),
    Kind("card", r"[0-9](?<![0-9][0-9])(?<![0-9][\x20-][0-9])(?:[\x20-]?[0-9]){13,18}(?![\x20-]?[0-9])", "regexp_like(text, '[0-9][ -]?[0-9]')", _LUHN, 0.7, "card|visa|mastercard|amex|credit|debit|payment", 0.3, True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "contains(text, '+')", f"length({_DIGITS}) between 10 and 15", 0.6, "phone|call|tel|mobile|fax|whatsapp", 0.3, True),
    Kind("iban", r"[A-Z](?<![A-Za-z0-9][A-Z])[A-Z][0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])", "regexp_like(text, '[A-Z]{2}[0-9]{2}')", f"length(replace(v, ' ', '')) between 15 and 34 and {_MOD97}", 0.7, "iban|account|bank|konto|compte", 0.3),
    Kind("ssn", r"[0-9](?<![0-9A-Za-z.-][0-9])[0-9]{2}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])", "contains(text, '-')", "substring(v, 1, 3) not in ('000', '666') and v < '9' and substring(v, 5, 2) <> '00' and right(v, 4) <> '0000'", 0.3, "ssn|social security|taxpayer", 0.5),
)
BASE = tuple(k.name for k in KINDS if k.base)


def _quoted(pattern: str) -> str:
    """A pattern as a SQL string literal."""
    return "r'" + pattern.replace("'", r"\x27") + "'"


def _bound(body: str, **values: str) -> str:
    """SQL: ``body`` over ``o.name`` for each value, each worked out once.

    A column that only a lambda function names would be worked out for every element.
    """
    fields = ", ".join(f"'{k}', {v}" for k, v in values.items())
    return f"transform(array(named_struct({fields})), o -> {body})[0]"


def _running(values: str, combined: str) -> str:
    """SQL: the running combination (of ``x`` and an earlier ``y``) over an array, by doubling: log(n) rounds of n steps."""
    earlier = combined.replace("y", "r[i - shiftleft(1, k)]")
    return f"aggregate(sequence(0, 30), {values}, (r, k) -> if(shiftleft(1, k) >= size(r), r, transform(r, (x, i) -> if(i >= shiftleft(1, k), {earlier}, x))))"


def _chunks(text: str) -> str:
    """SQL: a text as a list of chunks."""
    return f"regexp_extract_all({text}, '(?s).{{1,{CHUNK}}}', 0)"


def _part(chunks: str, start: str, length: str) -> str:
    """SQL: ``length`` code points from ``start`` (0 is the first), out of the chunks that hold them."""
    first = f"int(({start}) div {CHUNK})"
    return f"substring(array_join(slice({chunks}, {first} + 1, int((({start}) + ({length})) div {CHUNK}) - {first} + 1), ''), ({start}) % {CHUNK} + 1, {length})"


def _located(kind: Kind, order: int) -> str:
    """SQL: the confirmed matches of a kind as structs, from ``chunks``, ``m_kind`` (matches) and ``e_kind`` (where each ends)."""
    around = _part("o.chunks", f"greatest(s.start - {NEAR}, 0)", f"s.end + {NEAR} - greatest(s.start - {NEAR}, 0)")
    near = rf"regexp_like(lower({around}), '(?<![a-z])(?:{kind.near})(?![a-z])')"
    body = f"""transform(
        filter(
            transform(o.m, (v, i) -> named_struct('start', o.e[i] - length(v), 'kind_order', {order}, 'kind', '{kind.name}', 'end', o.e[i], 'value', v)),
            s -> exists(array(s.value), v -> {kind.holds})),
        s -> named_struct('start', s.start, 'kind_order', s.kind_order, 'kind', s.kind, 'end', s.end, 'value', s.value, 'score', double(least(1.0D, {kind.score}D + if({near}, {kind.lift}D, 0D)))))"""
    return f"if(size(m_{kind.name}) = 0, {_NONE}, {_bound(body, m=f'm_{kind.name}', e=f'e_{kind.name}', chunks='chunks')})"


_NONE = "cast(array() as array<struct<start:int,kind_order:int,kind:string,end:int,value:string,score:double>>)"


def find(docs: DataFrame, text: str = "text", spans: str = "spans", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """Add ``spans``: array<struct<start, kind_order, kind, end, value, score>> by start, then kind.

    Positions are code points from 0, ends exclusive.  Spans of a base kind
    never overlap within the kind; another kind's span is left out where it
    overlaps a base one.  A null or empty text has no spans.  Every input column
    but an earlier ``spans`` is kept, whatever its name; rows are independent.
    """
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != spans]).alias("row"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    matched = own.select("row", "text", *[F.expr(f"if({k.gate}, regexp_extract_all(text, {_quoted(k.pattern)}, 0), cast(array() as array<string>))").alias(f"m_{k.name}") for k in kinds])
    found = " or ".join(f"size(m_{k.name}) > 0" for k in kinds)
    between = [F.expr(f"if(size(m_{k.name}) > 0, split(text, {_quoted(k.pattern)}, -1), cast(array() as array<string>))").alias(f"g_{k.name}") for k in kinds]
    cut = matched.select("*", F.expr(f"if({found}, {_chunks('text')}, cast(array() as array<string>))").alias("chunks"), *between)
    lengths = "transform(o.m, (v, j) -> length(o.g[j]) + length(v))"
    ends = [F.expr(_bound(_running(lengths, "x + y"), m=f"m_{k.name}", g=f"g_{k.name}")).alias(f"e_{k.name}") for k in kinds]
    placed = cut.select("row", "chunks", *[f"m_{k.name}" for k in kinds], *ends)
    located = placed.select("row", *[F.expr(_located(k, i)).alias(f"s_{k.name}") for i, k in enumerate(kinds)])
    more = "concat(" + ", ".join([_NONE, *[f"filter(s_{k.name}, s -> s.score >= {THRESHOLD}D)" for k in kinds if not k.base]]) + ")"
    every = "array_sort(concat(" + ", ".join([_NONE, *[f"s_{k.name}" for k in kinds if k.base], "more"]) + "))"
    joined = located.select("row", *[f"s_{k.name}" for k in kinds if k.base], F.expr(more).alias("more")).select("row", F.expr("size(more) > 0").alias("mixed"), F.expr(every).alias("every"))
    base = "s.kind in (" + ", ".join(f"'{k.name}'" for k in kinds if k.base) + ")"
    # the furthest end of a base span up to each place, and the nearest begin of one from it on
    reach = _running(f"transform(every, s -> if({base}, s.end, 0))", "greatest(x, y)")
    ahead = _running(f"reverse(transform(every, s -> if({base}, s.start, {2**31 - 1})))", "least(x, y)")
    seen = f"filter(o.every, (s, i) -> {base} or (o.reach[i] <= s.start and o.ahead[size(o.every) - 1 - i] >= s.end))"
    kept = _bound(seen, every="every", reach=reach, ahead=ahead)
    return joined.select("row.*", F.expr(f"if(mixed, {kept}, every)").alias(spans))


def as_text(spans: str = "spans", kinds: tuple[str, ...] | None = None) -> F.Column:
    """Spans (of some kinds) as kind:start:end, comma-joined."""
    chosen = f"filter({spans}, s -> s.kind in ({', '.join(repr(k) for k in kinds)}))" if kinds else spans
    return F.expr(f"array_join(transform({chosen}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')")


def count(kind: str, spans: str = "spans") -> F.Column:
    return F.expr(f"bigint(size(filter({spans}, s -> s.kind = '{kind}')))")


def redacted(text: str = "text", spans: str = "spans") -> F.Column:
    """The text with every span replaced by its kind in brackets; of overlapping spans the first names the whole.

    A null text stays null.
    """
    before = "if(i = 0, 0, o.ends[i - 1])"
    piece = f"if(s.start >= {before}, concat({_part('o.chunks', before, f's.start - {before}')}, '[', upper(s.kind), ']'), '')"
    last = "o.ends[size(o.ends) - 1]"
    body = f"concat(array_join(transform(o.spans, (s, i) -> {piece}), ''), {_part('o.chunks', last, f'o.length - {last}')})"
    ends = _running(f"transform({spans}, s -> s.end)", "greatest(x, y)")
    return F.expr(f"if(size({spans}) = 0, `{text}`, {_bound(body, chunks=_chunks(f'`{text}`'), length=f'length(`{text}`)', spans=spans, ends=ends)})")
