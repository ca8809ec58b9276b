"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust their score.

Main path: DataFrame and SQL functions only. For each kind, one split and one extraction of the whole text by the pattern
give gaps and matches, whose lengths add up to the places of the matches in code points; higher-order functions drop the
matches that fail their check. Patterns are written so that Java's matcher neither recurses nor starts again inside a run.

Base kinds, always kept: email; ip (parts at most 255); card (12 to 19 digits passing Luhn); phone (9 to 15 digits). Added
by the method: iban (mod 97 is 1, not inside a longer word) and account (7 to 20 digits and dashes, kept only if a word such
as `passport` or `IBAN` stands within 40 characters before it). Scores are points of 100: a kind's own, and 15 more with a
word of its kind nearby; added spans need 60.

Null texts count as empty and have no spans; `redact` leaves them null. Very long texts are searched whole. Kinds may overlap; ties
of spans that start together go by the order of kinds. Repeated rows, and null doc_ids, are judged each. An empty table gives an
empty result. Extra columns are ignored by `span_digest` and kept by `find_spans` and `redact`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds in their order, pattern as Java reads it, as RE2 reads it, and points before context.
KINDS = (
    ("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", 90),
    ("ip", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", 70),
    ("card", r"[0-9](?:[\x20-]?+[0-9])++", r"[0-9](?:[\x20-]?[0-9])+", 80),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]", 70),
    ("iban", r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}+", r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", 80),
    ("account", r"[0-9][0-9-]{4,17}[0-9]", r"[0-9][0-9-]{4,17}[0-9]", 50),
)
BASE_KINDS, LEAST_POINTS, CONTEXT_CHARS, CONTEXT_POINTS = 4, 60, 40, 15
#: Words that stand near spans of a kind, in the four languages of most texts.
CONTEXT = {
    "email": "mail|contact|kontakt|correo|courriel|write to|schreib",
    "ip": "address|host|server|login|client|adresse|servidor|serveur",
    "card": "card|visa|mastercard|credit|karte|tarjeta|carte|payment",
    "phone": "phone|call|tel|mobile|fax|anruf|llame|appel",
    "iban": "iban|account|bank|konto|cuenta|compte",
    "account": "account|passport|ssn|social security|iban|konto|reisepass|cuenta|pasaporte|compte|passeport",
}
_SPAN = "array<struct<s:int,o:int,kind:string,e:int,points:int>>"


def _quoted(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\x27") + "'"


#: Fixed value: matches of a block. Places are added up within blocks and over blocks, so that work grows with a text's matches.
BLOCK = 64


def _numbers(items: str) -> str:
    return f"sequence(0, (size({items}) - 1) div {BLOCK})"


def _block(items: str, b: str) -> str:
    return f"slice({items}, {b} * {BLOCK} + 1, {BLOCK})"


def _found(kind: str) -> str:
    """Spans of the matches of one kind, before any check: s, e, value v, and what stands before and after it.

    A block's own stretch of the text is cut out once; what a match needs of the text is cut out of that.
    """
    pairs, sums, starts = (f"_pii_{x}_{kind}" for x in ("pairs", "sums", "starts"))
    stretch = f"transform(array(greatest({starts}[b] - {CONTEXT_CHARS}, 0)), t -> struct({starts}[b] as p, t as t, substr(_pii_text, t + 1, {starts}[b] - t + {sums}[b] + 1) as text))[0]"
    span = f"struct(acc.p + x.g as s, acc.p + x.g + x.l as e, x.v as v, substr(k.text, greatest(acc.p + x.g - {CONTEXT_CHARS}, 0) - k.t + 1, least(acc.p + x.g, {CONTEXT_CHARS})) as before, substr(k.text, acc.p + x.g + x.l - k.t + 1, 1) as after)"
    spans = f"aggregate({_block(pairs, 'b')}, struct(k.p as p, cast(array() as array<struct<s:int,e:int,v:string,before:string,after:string>>) as a), (acc, x) -> struct(acc.p + x.g + x.l as p, concat(acc.a, array({span})) as a), acc -> acc.a)"
    return f"flatten(transform({_numbers(pairs)}, b -> transform(array({stretch}), k -> {spans})[0]))"


#: The check of each kind, over a span x.
_CHECKS = {
    "email": "true",
    "ip": "forall(split(x.v, r'\\.'), p -> length(ltrim('0', p)) <= 3 and cast(concat('0', substr(ltrim('0', p), 1, 3)) as int) <= 255)",
    "card": "length(regexp_replace(x.v, '[^0-9]', '')) between 12 and 19 and luhn_check(regexp_replace(x.v, '[^0-9]', ''))",
    "phone": "length(regexp_replace(x.v, '[^0-9]', '')) between 9 and 15",
    "iban": """not rlike(right(x.before, 1), '[A-Za-z0-9]') and not rlike(x.after, '[A-Za-z0-9]')
        and aggregate(sequence(1, length(x.v)), 0, (r, i) -> cast(
            if(substr(concat(substr(x.v, 5), substr(x.v, 1, 4)), i, 1) between '0' and '9',
               r * 10 + ascii(substr(concat(substr(x.v, 5), substr(x.v, 1, 4)), i, 1)) - 48,
               r * 100 + ascii(substr(concat(substr(x.v, 5), substr(x.v, 1, 4)), i, 1)) - 55) % 97 as int)) = 1""",
    "account": "length(regexp_replace(x.v, '[^0-9]', '')) >= 7 and not rlike(right(x.before, 1), '[A-Za-z0-9.+]') and not rlike(x.after, '[A-Za-z0-9]')",
}
#: Whether a text can have a match at all: a cheap look before the patterns.
_MAY = {"email": "contains(_pii_text, '@')", "ip": "contains(_pii_text, '.') and _pii_digit", "card": "_pii_digit", "phone": "contains(_pii_text, '+') and _pii_digit", "iban": "_pii_digit", "account": "_pii_digit"}


def find_spans(docs: DataFrame) -> DataFrame:
    """`_pii_own` (the row of docs as a struct), `_pii_text` and `_pii_spans` (s, o, kind, e, points; sorted by start, then kind)."""
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_pii_own"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_pii_text")).withColumn("_pii_digit", F.expr("rlike(_pii_text, '[0-9]')"))
    out = out.select("*", *[F.expr(f"if({_MAY[kind]}, split(_pii_text, {_quoted(java)}, -1), array(_pii_text))").alias(f"_pii_gap_{kind}") for kind, java, _, _ in KINDS])
    out = out.select("*", *[F.expr(f"if(size(_pii_gap_{kind}) > 1, regexp_extract_all(_pii_text, {_quoted(java)}, 0), cast(array() as array<string>))").alias(f"_pii_hit_{kind}") for kind, java, _, _ in KINDS])
    out = out.select("*", *[F.expr(f"zip_with(slice(_pii_gap_{kind}, 1, size(_pii_hit_{kind})), _pii_hit_{kind}, (g, h) -> struct(length(g) as g, length(h) as l, h as v))").alias(f"_pii_pairs_{kind}") for kind, *_ in KINDS])
    out = out.select("*", *[F.expr(f"transform({_numbers(f'_pii_pairs_{kind}')}, b -> aggregate({_block(f'_pii_pairs_{kind}', 'b')}, 0, (n, x) -> n + x.g + x.l))").alias(f"_pii_sums_{kind}") for kind, *_ in KINDS])
    out = out.select("*", *[F.expr(f"transform(_pii_sums_{kind}, (_, b) -> aggregate(slice(_pii_sums_{kind}, 1, b), 0, (n, x) -> n + x))").alias(f"_pii_starts_{kind}") for kind, *_ in KINDS])
    parts = []
    for order, (kind, _, _, points) in enumerate(KINDS):
        spans = f"filter(if(size(_pii_hit_{kind}) = 0, cast(array() as array<struct<s:int,e:int,v:string,before:string,after:string>>), {_found(kind)}), x -> {_CHECKS[kind]})"
        near = f"rlike(lower(x.before), '{CONTEXT[kind]}')"
        scored = f"transform({spans}, x -> struct(x.s as s, {order} as o, '{kind}' as kind, x.e as e, {points} + if({near}, {CONTEXT_POINTS}, 0) as points))"
        parts.append(f"cast({scored if order < BASE_KINDS else f'filter({scored}, y -> y.points >= {LEAST_POINTS})'} as {_SPAN})")
    out = out.select("*", *[F.expr(p).alias(f"_pii_found_{kind}") for p, (kind, *_) in zip(parts, KINDS, strict=True)])
    # An account that lies inside a span of another kind is that span.
    others = ", ".join(f"_pii_found_{kind}" for kind, *_ in KINDS[:-1])
    clear = f"if(size(_pii_found_account) = 0, _pii_found_account, filter(_pii_found_account, x -> not exists(concat({others}), y -> x.s < y.e and y.s < x.e)))"
    out = out.withColumn("_pii_spans", F.expr(f"array_sort(concat({others}, {clear}))"))
    return out.select("_pii_own", "_pii_text", "_pii_spans")


def _joined(spans: str) -> str:
    return f"array_join(transform({spans}, x -> concat(x.kind, ':', x.s, ':', x.e)), ',')"


def span_digest(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the kinds, base_sha256, spans, points."""
    found = find_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    counts = [F.expr(f"cast(size(filter(_pii_spans, x -> x.kind = '{kind}')) as bigint)").alias(f"n_{kind}") for kind, *_ in KINDS]
    return found.select(
        F.col("_pii_own.doc_id").alias("doc_id"),
        *counts,
        F.expr(f"sha2({_joined(f'filter(_pii_spans, x -> x.o < {BASE_KINDS})')}, 256)").alias("base_sha256"),
        F.expr(_joined("_pii_spans")).alias("spans"),
        F.expr("array_join(transform(_pii_spans, x -> cast(x.points as string)), ',')").alias("points"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span replaced by its kind in angle brackets, `<email>`; overlapping spans are replaced as one.

    A span behind the furthest end so far begins a replacement and brings along the text since that end; others only move the end.
    """
    found = find_spans(docs)
    spans = "_pii_spans"
    found = found.withColumn("_pii_ends", F.expr(f"transform({_numbers(spans)}, b -> aggregate({_block(spans, 'b')}, 0, (n, x) -> greatest(n, x.e)))"))
    found = found.withColumn("_pii_from", F.expr("transform(_pii_ends, (_, b) -> aggregate(slice(_pii_ends, 1, b), 0, (n, x) -> greatest(n, x)))"))
    piece = "if(x.s >= acc.p, concat(acc.a, array(substr(k.text, acc.p - k.p + 1, x.s - acc.p), concat('<', x.kind, '>'))), acc.a)"
    stretch = "struct(_pii_from[b] as p, substr(_pii_text, _pii_from[b] + 1, greatest(_pii_ends[b] - _pii_from[b], 0)) as text)"
    block = f"aggregate({_block(spans, 'b')}, struct(k.p as p, cast(array() as array<string>) as a), (acc, x) -> struct(greatest(acc.p, x.e) as p, {piece} as a), acc -> array_join(acc.a, ''))"
    rebuilt = f"concat(array_join(transform({_numbers(spans)}, b -> transform(array({stretch}), k -> {block})[0]), ''), substr(_pii_text, array_max(_pii_ends) + 1))"
    return found.select(*[F.expr(f"if(size(_pii_spans) = 0, _pii_own.text, {rebuilt})").alias("text") if n == "text" else F.col("_pii_own")[n].alias(n) for n in docs.columns])


def _oracle() -> str:
    """The same in DuckDB's SQL."""
    alpha = "'[A-Za-z0-9]'"
    check = {
        "email": "true",
        "ip": "len(list_filter(string_split(x.v, '.'), lambda p: length(ltrim(p, '0')) > 3 or cast('0' || substr(ltrim(p, '0'), 1, 3) as integer) > 255)) = 0",
        "card": """length(regexp_replace(x.v, '[^0-9]', '', 'g')) between 12 and 19 and
            list_sum(list_transform(range(1, length(regexp_replace(x.v, '[^0-9]', '', 'g')) + 1), lambda i:
                case when i % 2 = 1 then cast(substr(reverse(regexp_replace(x.v, '[^0-9]', '', 'g')), i, 1) as integer)
                     else [0, 2, 4, 6, 8, 1, 3, 5, 7, 9][cast(substr(reverse(regexp_replace(x.v, '[^0-9]', '', 'g')), i, 1) as integer) + 1] end)) % 10 = 0""",
        "phone": "length(regexp_replace(x.v, '[^0-9]', '', 'g')) between 9 and 15",
        "iban": f"""not regexp_matches(case when x.s = 0 then '' else substr(t, x.s, 1) end, {alpha}) and not regexp_matches(substr(t, x.e + 1, 1), {alpha}) and
            list_reduce(list_transform(range(1, length(x.v) + 1), lambda i: cast(ascii(substr(substr(x.v, 5) || substr(x.v, 1, 4), i, 1)) as bigint)),
                lambda r, c: (case when c < 58 then r * 10 + c - 48 else r * 100 + c - 55 end) % 97, cast(0 as bigint)) = 1""",
        "account": f"""length(regexp_replace(x.v, '[^0-9]', '', 'g')) >= 7 and
            not regexp_matches(case when x.s = 0 then '' else substr(t, x.s, 1) end, '[A-Za-z0-9.+]') and not regexp_matches(substr(t, x.e + 1, 1), {alpha})""",
    }
    raw, spans, scored = [], [], []
    for order, (kind, _, re2, points) in enumerate(KINDS):
        raw.append(f"regexp_extract_all(t, '{re2}') as h_{kind}, string_split_regex(t, '{re2}') as g_{kind}")
        spans.append(f"list_transform(range(1, len(h_{kind}) + 1), lambda i: {{'s': cast(list_sum(list_transform(g_{kind}[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(h_{kind}[1:i - 1], lambda y: length(y))), 0) as integer), 'v': h_{kind}[i]}}) as p_{kind}")
        near = f"regexp_matches(lower(substr(t, greatest(x.s - {CONTEXT_CHARS}, 0) + 1, least(x.s, {CONTEXT_CHARS}))), '{CONTEXT[kind]}')"
        whole = f"list_transform(p_{kind}, lambda x: {{'s': x.s, 'e': x.s + length(x.v), 'v': x.v}})"
        least = f"list_filter(list_transform(list_filter({whole}, lambda x: {check[kind]}), lambda x: {{'s': x.s, 'o': {order}, 'kind': '{kind}', 'e': x.e, 'points': {points} + case when {near} then {CONTEXT_POINTS} else 0 end}}), lambda y: y.points >= {LEAST_POINTS if order >= BASE_KINDS else 0})"
        scored.append(f"{least} as f_{kind}")
    others = " || ".join(f"f_{kind}" for kind, *_ in KINDS[:-1])
    joined = "list_aggregate(list_transform({0}, lambda x: x.kind || ':' || x.s || ':' || x.e), 'string_agg', ',')"
    counts = ", ".join(f"cast(len(list_filter(spans_, lambda x: x.kind = '{kind}')) as bigint) as n_{kind}" for kind, *_ in KINDS)
    return f"""with a as (select doc_id, coalesce(text, '') as t from documents),
        b as (select doc_id, t, {', '.join(raw)} from a),
        c as (select *, {', '.join(spans)} from b),
        d as (select doc_id, {', '.join(scored)} from c),
        e as (select doc_id, list_sort(({others}) || list_filter(f_account, lambda x: len(list_filter({others}, lambda y: x.s < y.e and y.s < x.e)) = 0)) as spans_ from d)
        select doc_id, {counts},
            sha256(coalesce({joined.format(f"list_filter(spans_, lambda x: x.o < {BASE_KINDS})")}, '')) as base_sha256,
            coalesce({joined.format('spans_')}, '') as spans,
            coalesce(list_aggregate(list_transform(spans_, lambda x: cast(x.points as varchar)), 'string_agg', ','), '') as points
        from e"""


ORACLE = _oracle()
