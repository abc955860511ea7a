"""Format-preserving pseudonyms: validated numbers, dates and addresses are keyed-permuted within their format.

A value's letters and digits are split into two halves and put through a keyed Feistel network whose
rounds add hash digits modulo 10 or 26, position by position; all other characters stay. So a value maps
to one value of the same format, different values stay different, and equal values stay linked across
documents. Where a format has rules the network walks its cycle until they hold (dialling codes, social
security numbers, days of the years 1900 to 2099) or the check digits are computed anew (cards, IBANs).

Found: e-mail addresses (the domain stays), IBANs that pass modulo 97, IPv4 addresses, telephone numbers,
dates (2024-02-29, 29.02.2024, 02/29/2024), social security numbers, and card numbers that pass the
Luhn check. What looks alike but fails its check stays as it is.

Only DataFrame functions are used. Cases: null texts stay null and empty ones empty, with no value
found; repeated rows and values get the same pseudonyms; further columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._shared import fresh, table

#: The setting that holds the key of the registered query, and the key that it takes where none is set, on these invented texts.
#: Whoever knows the key can undo the pseudonyms, so :func:`pseudonymise` has no default.
KEY_SETTING, OPEN_KEY = "spark.tidemark.pseudonym.key", "an open key for test tables"
ROUNDS, WALKS = 8, 64
FIRST_DAY, DAYS = "1900-01-01", 73049

#: Fixed formats, in the order in which they are tried at a place.
FORMATS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])",
    "ipv4": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9])",
    "phone": r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?)?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "day": r"(?<![0-9./-])(?:(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.(?:19|20)[0-9]{2}|[0-9]{2}/[0-9]{2}/(?:19|20)[0-9]{2})(?![0-9/-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
}
PATTERN = "|".join(FORMATS.values())


def _text(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _bind(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` standing for a value that is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def network(codes: str, sizes: str, key: str, kind: str) -> str:
    """SQL for an array of numbers permuted by the Feistel network, each below its entry of ``sizes``."""
    prf = lambda salt: f"sha2(concat_ws('|', {_text(key)}, {_text(kind)}, {salt}, array_join(s.b, ',')), 256)"
    added = "transform(s.a, (x, i) -> cast(pmod(x + cast(conv(substr(f, 1 + 4 * (i % 32), 4), 16, 10) as int), element_at(s.p, i + 1)) as int))"
    merged = _bind(f"concat({prf('cast(r as string)')}, {prf('concat(cast(r as string), chr(43))')})", "f", f"named_struct('a', s.b, 'b', {added}, 'p', s.q, 'q', s.p)")
    cut = lambda a: (f"slice({a}, 1, cast(size({a}) div 2 as int))", f"slice({a}, cast(size({a}) div 2 as int) + 1, size({a}))")
    (a, b), (p, q) = cut("cs"), cut("ns")
    run = f"aggregate(sequence(0, {ROUNDS - 1}), named_struct('a', {a}, 'b', {b}, 'p', {p}, 'q', {q}), (s, r) -> {merged}, s -> concat(s.a, s.b))"
    return _bind(codes, "cs", _bind(sizes, "ns", run))


def permuted(value: str, key: str, kind: str, lo: str = "1", hi: str = "length(z)") -> str:
    """SQL for the pseudonym of a value's letters and digits at the places ``lo`` to ``hi`` of z, the value."""
    zero = "case when substr(z, k, 1) rlike '[0-9]' then 48 when substr(z, k, 1) rlike '[A-Z]' then 65 else 97 end"
    codes = f"transform(ix, k -> ascii(substr(z, k, 1)) - {zero})"
    sizes = "transform(ix, k -> case when substr(z, k, 1) rlike '[0-9]' then 10 else 26 end)"
    char = f"case when array_position(ix, k) > 0 then chr(element_at(v, cast(array_position(ix, k) as int)) + {zero}) else substr(z, k, 1) end"
    whole = _bind(network(codes, sizes, key, kind), "v", f"array_join(transform(sequence(1, length(z)), k -> {char}), '')")
    places = f"filter(sequence(1, length(z)), k -> k between {lo} and {hi} and substr(z, k, 1) rlike '[0-9A-Za-z]')"
    return _bind(value, "z", _bind(places, "ix", f"case when size(ix) = 0 then z else {whole} end"))


def walked(value: str, valid: str, key: str, kind: str, lo: str = "1", hi: str = "length(z)") -> str:
    """The first value on the cycle, after the value itself, for which ``valid`` (of w) holds."""
    seek = f"aggregate(sequence(1, {WALKS}), {permuted(value, key, kind, lo, hi)}, (w, n) -> case when {valid} then w else {permuted('w', key, kind, lo, hi)} end)"
    return _bind(seek, "w", f"case when {valid} then w else raise_error('a cycle walk did not end') end")


def _luhn(digits: str, odd: int) -> str:
    """The Luhn sum of a string of digits; ``odd`` tells which digits from the right are doubled."""
    d = "cast(substr(y, -g, 1) as int)"
    return _bind(digits, "y", f"aggregate(sequence(1, length(y)), 0, (t, g) -> t + case when g % 2 = {odd} then {d} * 2 - case when {d} > 4 then 9 else 0 end else {d} end)")


def _mod97(value: str) -> str:
    """An IBAN's value modulo 97, from its characters with the first four moved to the end."""
    digit = "case when substr(y, g, 1) rlike '[0-9]' then ascii(substr(y, g, 1)) - 48 else ascii(substr(y, g, 1)) - 55 end"
    return _bind(value, "y", f"aggregate(sequence(1, length(y)), 0, (t, g) -> (t * case when substr(y, g, 1) rlike '[0-9]' then 10 else 100 end + {digit}) % 97)")


def _day_formats(value: str) -> str:
    return f"case when {value} rlike '-' then 'yyyy-MM-dd' when {value} rlike '/' then 'MM/dd/yyyy' else 'dd.MM.yyyy' end"


NANP = "regexp_replace({0}, '[^0-9]', '') rlike '^[0-9]*[2-9][0-9]{{2}}[2-9][0-9]{{6}}$'"
SSN = "{0} rlike '^(?!000|666|9)[0-9]{{3}}-(?!00)[0-9]{{2}}-(?!0000)[0-9]{{4}}$'"


def valid_of(kind: str, value: str) -> str:
    """SQL for the check of a value of a kind."""
    digits = f"regexp_replace({value}, '[^0-9]', '')"
    return {
        "email": "true",
        "iban": f"({_mod97(f'concat(substr({value}, 5), substr({value}, 1, 4))')}) = 1",
        "ipv4": f"forall(split({value}, '[.]'), o -> cast(o as int) <= 255)",
        "phone": NANP.format(value),
        "day": f"coalesce(try_to_date({value}, {_day_formats(value)}) between date'{FIRST_DAY}' and date_add(date'{FIRST_DAY}', {DAYS - 1}), false)",
        "ssn": SSN.format(value),
        "card": f"({_luhn(digits, 0)}) % 10 = 0",
    }[kind]


def pseudonym_of(kind: str, value: str, key: str) -> str:
    """SQL for the pseudonym of a valid value of a kind."""
    if kind == "email":
        return permuted(value, key, kind, hi="instr(z, '@') - 1")
    if kind == "iban":
        moved = permuted(value, key, kind, lo="5")
        check = _mod97("concat(substr(c, 5), substr(c, 1, 2), '00')")
        return _bind(moved, "c", f"concat(substr(c, 1, 2), lpad(cast(98 - {check} as string), 2, '0'), substr(c, 5))")
    if kind == "ipv4":
        octets = f"transform(split({value}, '[.]'), o -> cast(o as int))"
        return f"array_join(transform({network(octets, 'array(256, 256, 256, 256)', key, kind)}, o -> cast(o as string)), '.')"
    if kind == "phone":
        return walked(value, NANP.format("w"), key, kind, lo="length(z) - length(regexp_extract(z, '[(]?[0-9]{3}[)]?[ .-][0-9]{3}[ .-][0-9]{4}$', 0)) + 1")
    if kind == "day":
        number = f"lpad(cast(datediff(try_to_date({value}, {_day_formats(value)}), date'{FIRST_DAY}') as string), 5, '0')"
        return f"date_format(date_add(date'{FIRST_DAY}', cast({walked(number, f'cast(w as int) < {DAYS}', key, kind)} as int)), {_day_formats(value)})"
    if kind == "ssn":
        return walked(value, SSN.format("w"), key, kind)
    if kind == "card":
        moved = permuted(value, key, kind, hi="length(z) - 1")
        check = _luhn("regexp_replace(substr(c, 1, length(c) - 1), '[^0-9]', '')", 1)
        return _bind(moved, "c", f"concat(substr(c, 1, length(c) - 1), cast((10 - {check} % 10) % 10 as string))")
    raise ValueError(kind)


def _kind(value: str) -> str:
    """Which format a found value has: the first that matches it whole."""
    plain = {k: p[p.index(")") + 1 :] if p.startswith("(?<!") else p for k, p in FORMATS.items()}
    plain = {k: p[: p.rindex("(?!")] if "(?!" in p else p for k, p in plain.items()}
    return "case " + " ".join(f"when {value} rlike {_text('^(?:' + p + ')$')} then '{k}'" for k, p in plain.items()) + " end"


def pseudonymise(docs: DataFrame, key: str, text: str = "text", into: str = "_found") -> DataFrame:
    """``docs`` with valid values in ``text`` replaced, and ``into``: (kind, pseudonym) of each in order; a column of that name is replaced."""
    if not key:
        raise ValueError("a key is needed")
    if text == into:
        raise ValueError("the text cannot be replaced")
    docs = docs.drop(into)
    some = F.col(text).rlike("[0-9@]")
    values, found, parts = fresh(docs, "values", "found", "parts")
    met = docs.withColumn(values, F.when(some, F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))))
    each = " ".join(f"when d = '{k}' and {valid_of(k, 'e')} then named_struct('kind', d, 'said', {pseudonym_of(k, 'e', key)})" for k in FORMATS)
    every = f"case {each} else named_struct('kind', cast(null as string), 'said', e) end"
    new = f"transform({values}, e -> {_bind(_kind('e'), 'd', every)})"
    named = met.withColumn(found, F.when(F.size(values) > 0, F.expr(new)))
    split = named.withColumn(parts, F.when(F.size(values) > 0, F.split(text, PATTERN, -1)))
    joined = F.expr(f"array_join(transform({parts}, (x, i) -> concat(x, case when i < size({found}) then element_at({found}, i + 1).said else '' end)), '')")
    changed = F.when(F.col(parts).isNotNull(), joined).otherwise(F.col(text)).alias(text)
    names = [changed if c == text else F.col(c) for c in docs.columns]
    return split.select(*names, F.expr(f"coalesce(filter({found}, x -> x.kind is not null), array())").alias(into))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its pseudonymised text, how many values it held, and their kinds."""
    key = spark.conf.get(KEY_SETTING, OPEN_KEY)
    out = pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), key)
    return out.select("doc_id", "text", F.size("_found").cast("long").alias("n_found"), F.array_join(F.expr("transform(_found, x -> x.kind)"), ",").alias("kinds"))
