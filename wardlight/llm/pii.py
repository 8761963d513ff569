"""Personal data: format-preserving Feistel pseudonyms, in SQL expressions only.

Found are numbers that pass their own check (payment cards by check digit, IBANs by remainder, telephone
numbers and addresses of hosts by their ranges, social security numbers by form), real dates, mail addresses
and secrets. Each is permuted under a key within its format: letters stay letters of their case, digits
digits, separators stay. A value is split into halves, and each round moves the characters of one half by a
hash of the other half; so it is a permutation, and equal values get equal pseudonyms in every document.
Cards and IBANs get check digits that hold; dates are permuted as day numbers and stay dates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sharding import permuted

ROUNDS = 6
FIRST_DAY, DAYS = "1900-01-01", 73_049  # to 2099-12-31

#: Length of an IBAN by country
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_COUNTRIES = "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items())
_DATED = r"(?![./][0-9]{1,3}[./][0-9])"  # a group that begins a date or an address of a host

#: (kind, pattern); the first that matches at a place holds
PATTERNS = (
    ("email", r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"),
    ("secret", r"(?<![A-Z0-9])AKIA[0-9A-Z]{16}(?![A-Z0-9])"),
    ("secret", r"(?<=password=)[^\s\"']+"),
    ("secret", r"(?<![0-9A-Za-z])(?=[a-f]*[0-9])[0-9a-f]{32,128}(?![0-9A-Za-z])"),
    ("iban", rf"(?<![A-Z0-9])(?:{_COUNTRIES})(?![A-Z0-9])"),
    ("iban", r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Z0-9])"),
    ("phone", r"(?<![0-9+])\+[0-9]{1,3}(?:[ .-]\(?[0-9]{1,5}\)?(?:[ .-][0-9]{4}){2}|[ .-]\(?[0-9]{1,3}\)?(?:[ .-][0-9]{2}){4}|(?:[ .-][0-9]{2}){4}|[ .-]\(?[0-9]{1,5}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}|[ .-]\(?[0-9]{2,5}\)?[ .-][0-9]{5,8})(?![0-9])"),
    ("phone", r"(?<![0-9+])\+[0-9]{10,15}(?![0-9])"),
    ("phone", r"(?<![0-9+])\+[0-9]{1,3}[ -]?\(?[0-9]{2,4}\)?[ -]?[0-9]{3}[ -]?[0-9]{3,4}(?![0-9])"),
    ("phone", r"(?<![0-9])\([0-9]{3}\) [0-9]{3}-[0-9]{4}(?![0-9])"),
    ("phone", r"(?<![0-9.-])[0-9]{3}(?:-[0-9]{3}-[0-9]{4}|\.[0-9]{3}\.[0-9]{4})(?![0-9]|[.-][0-9])"),
    ("date", r"(?<![0-9./-])(?:19|20)[0-9]{2}(?:-[0-9]{1,2}-|/[0-9]{1,2}/|\.[0-9]{1,2}\.)[0-9]{1,2}(?![0-9]|[./-][0-9])"),
    ("date", r"(?<![0-9./-])[0-9]{1,2}(?:-[0-9]{1,2}-|/[0-9]{1,2}/|\.[0-9]{1,2}\.)(?:19|20)[0-9]{2}(?![0-9]|[./-][0-9])"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("host", r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"),
    # a whole run of groups, cut into values afterwards
    ("card", rf"(?<![0-9])(?=(?:[0-9][ -]?){{12}}[0-9])[0-9]++(?:[ -][0-9]++{_DATED})*+"),
)
ANY = "|".join(p for _, p in PATTERNS)


def _lit(text: str) -> str:
    return "r'" + text.replace("'", "\\x27") + "'"


def _moved(half: str, other: str, rnd: str, key: int, hexadecimal: str) -> str:
    """Characters of ``half`` moved within their class by a hash of the other half, the round and the place."""
    move = f"xxhash64({other}, {rnd}, i, {key}L, length({half}))"

    def shift(first: str, size: str) -> str:
        return f"chr(ascii('{first}') + pmod(ascii(c) - ascii('{first}') + pmod({move}, {size}), {size}))"

    return f"""array_join(transform(split({half}, ''), (c, i) -> case
        when c = '' then ''
        when c >= '0' and c <= '9' then {shift('0', '10')}
        when {hexadecimal} and c >= 'a' and c <= 'f' then {shift('a', '6')}
        when c >= 'a' and c <= 'z' then {shift('a', '26')}
        when c >= 'A' and c <= 'Z' then {shift('A', '26')}
        else c end), '')"""


def permuted_text(value: str, key: int, hexadecimal: str = "false") -> str:
    """SQL for the Feistel permutation of a string's letters and digits in place."""
    cut = f"cast(length({value}) div 2 as int)"
    rounds = ", ".join(f"named_struct('turn', {k % 2}, 'k', {k})" for k in range(ROUNDS))
    return f"""aggregate(array({rounds}), named_struct('l', substr({value}, 1, {cut}), 'r', substr({value}, {cut} + 1)),
        (s, q) -> if(q.turn = 0,
            named_struct('l', {_moved('s.l', 's.r', 'q.k', key, hexadecimal)}, 'r', s.r),
            named_struct('l', s.l, 'r', {_moved('s.r', 's.l', 'q.k', key, hexadecimal)})),
        s -> concat(s.l, s.r))"""


def _check_digit(digits: str, skip: int) -> str:
    """Sum of the card check over ``digits``; ``skip``: 1 if the check digit is among them, else 0."""
    return f"""aggregate(transform(split(reverse({digits}), ''), (c, i) -> case when c = '' then 0
        when (i + {1 - skip}) % 2 = 0 then ascii(c) - 48
        when ascii(c) > 52 then 2 * (ascii(c) - 48) - 9 else 2 * (ascii(c) - 48) end), 0, (a, b) -> a + b)"""


def _iban_rest(text: str) -> str:
    """Remainder by 97 of the moved and spelled-out IBAN (without spaces)."""
    moved = f"concat(substr({text}, 5), substr({text}, 1, 4))"
    return f"""aggregate(split({moved}, ''), 0, (a, c) -> case when c = '' then a
        when c >= '0' and c <= '9' then (a * 10 + ascii(c) - 48) % 97 else (a * 100 + ascii(c) - 55) % 97 end)"""


def _put_back(shape: str, chars: str) -> str:
    """``chars`` in the places of the letters and digits of ``shape``; its other characters stay."""
    return f"""aggregate(split({shape}, ''), named_struct('done', '', 'n', 1), (s, c) -> if(c rlike '[A-Za-z0-9]',
        named_struct('done', concat(s.done, substr({chars}, s.n, 1)), 'n', s.n + 1), named_struct('done', concat(s.done, c), 'n', s.n)), s -> s.done)"""


def _one(name: str, inner: str, body: str) -> str:
    """SQL: a name for a value, by an array of one."""
    return f"element_at(transform(array({inner}), {name} -> {body}), 1)"


def _date(m: str, key: int) -> str:
    """SQL: the pseudonym of a date, in its own order of parts and with its own separators."""
    permuted_day = permuted("d", DAYS, key)
    # month first is read only where day first is no date, so the day is over 12 and stays so: walk on until it is
    late = f"aggregate(sequence(1, 60), d, (a, k) -> if(k > 1 and dayofmonth(date_add(date'{FIRST_DAY}', cast(a as int))) > 12, a, {permuted('a', DAYS, key)}))"

    def dated(form: str, moved: str) -> str:
        wide = form.replace("d", "dd").replace("M", "MM")
        shown = _one("o", f"date_add(date'{FIRST_DAY}', cast({moved} as int))", f"if(t rlike '(^|[^0-9])[0-9]([^0-9]|$)', date_format(o, '{form}'), date_format(o, '{wide}'))")
        return _one("d", f"cast(datediff(try_to_date(t, '{form}'), date'{FIRST_DAY}') as bigint)", f"if(d is null, null, {shown})")

    moved = f"if(t rlike '^[0-9]{{4}}', {dated('yyyy-M-d', permuted_day)}, coalesce({dated('d-M-yyyy', permuted_day)}, {dated('M-d-yyyy', late)}))"
    return _one("t", f"translate({m}, '/.', '--')", f"coalesce(replace({moved}, '-', regexp_extract({m}, '[-./]', 0)), {m})")


def pseudonym(m: str, key: int, piece: bool = False) -> str:
    """SQL: the pseudonym of a found value ``m``, or ``m`` itself where its check fails; a ``piece`` is one value of a run.

    The kind comes first, then the characters to permute, then what they are put into, so that the permutation stands
    here once: the text is parsed and planned on the driver, where its size counts. For the same reason it says
    ``named_struct`` and ``substr``, which the parser knows at the name; ``struct`` makes it look ahead to the end.
    """

    def holds(kind: str) -> str:
        return " or ".join(f"{m} rlike {_lit('^(?:' + p.replace('(?<=password=)', '') + ')$')}" for k, p in PATTERNS if k == kind)

    digits, plain = f"regexp_replace({m}, '[^0-9]', '')", f"replace({m}, ' ', '')"
    phone = f"when {holds('phone')} then if(length({digits}) between 10 and 15, 'phone', 'none') when {holds('date')} then 'date' when {holds('ssn')} then 'ssn'"
    if piece:
        kind = f"case {phone} when {_check_digit(digits, 1)} % 10 <> 0 or {digits} rlike '^0+$' then 'none' else 'card' end"
        others = ""
    else:
        kind = f"""case when {m} like '%@%' then 'mail' when {holds('iban')} then if({_iban_rest(plain)} = 1, 'iban', 'none') {phone} when {holds('host')} then 'host'
            when {m} rlike '^[0-9][0-9 -]*$' and not {m} rlike '^[0-9]{{32,128}}$' then 'run' when {m} like 'AKIA%' then 'aws' when {m} rlike '^[0-9a-f]+$' then 'hex' else 'secret' end"""
        number = permuted("d[0] * 16777216L + d[1] * 65536 + d[2] * 256 + d[3]", 1 << 32, key)
        host = _one("d", f"transform(split({m}, '[.]'), x -> try_cast(x as int))", f"if(exists(d, x -> x > 255), {m}, " + _one(
            "p", number, "concat_ws('.', array(string(p div 16777216), string(p div 65536 % 256), string(p div 256 % 256), string(p % 256)))") + ")")
        others = f"when 'host' then {host} when 'run' then {_run(m, key)}"
    spelled = "concat(substr(d, 1, 2), '00', p)"
    own = f"""case k when 'card' then substr({digits}, 1, length({digits}) - 1) when 'ssn' then {digits} when 'phone' then right({digits}, 10)
        when 'mail' then substring_index({m}, '@', 1) when 'iban' then substr({plain}, 5) when 'aws' then substr({m}, 5) else {m} end"""
    chars = f"""case k when 'card' then concat(p, cast((10 - {_check_digit('p', 0)} % 10) % 10 as string)) when 'ssn' then p when 'phone' then concat(substr({digits}, 1, length({digits}) - 10), p)
        when 'iban' then {_one('d', plain, _one('z', spelled, f"concat(substr(d, 1, 2), lpad(cast(98 - {_iban_rest('z')} as string), 2, '0'), p)"))} end"""
    back = f"""case k when 'mail' then concat(p, substr({m}, length(d) + 1)) when 'aws' then concat('AKIA', p) when 'hex' then p when 'secret' then p
        else {_one('w', chars, _put_back(m, 'w'))} end"""
    body = _one("d", own, _one("p", permuted_text("d", key, "k = 'hex'"), back))
    return _one("k", kind, f"case k when 'none' then {m} when 'date' then {_date(m, key)} {others} else {body} end")


def _run(m: str, key: int) -> str:
    """SQL: a run of groups of digits with its values replaced. At each group the longest stretch of groups that is
    a card holds, else three groups that are a date, a telephone or a social security number; else the group stays."""
    g, seps = f"regexp_extract_all({m}, '[0-9]+', 0)", f"regexp_extract_all({m}, '[ -]', 0)"
    digits = "array_join(slice(g, i + 1, n), '')"
    card = f"length({digits}) between 13 and 19 and {_check_digit(digits, 1)} % 10 = 0 and not {digits} rlike '^0+$'"
    stretch = "array_join(zip_with(slice(g, i + 1, n), slice(s, i + 1, n - 1), (a, b) -> concat(a, coalesce(b, ''))), '')"
    three = stretch.replace("n - 1", "2").replace(", n)", ", 3)")
    other = "(?:(?:19|20)[0-9]{2}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{1,2}-[0-9]{1,2}-(?:19|20)[0-9]{2}|[0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9]{4})"
    alone = "(i = 0 or s[i - 1] = ' ') and coalesce(get(s, i + 2), ' ') = ' '"
    # how many groups from group i on are one value
    size = f"""coalesce(array_max(filter(sequence(1, least(19, size(g) - i)), n -> {card})), if({alone} and {three} rlike '^{other}$', 3, 1))"""
    value = f"if(n = 1 and length(c) not between 13 and 19, c, {pseudonym('c', key, piece=True)})"
    step = _one("n", size, _one("c", stretch, f"named_struct('done', concat(t.done, if(i = 0, '', s[i - 1]), {value}), 'free', cast(i + n as int))"))
    cut = f"aggregate(sequence(0, size(g) - 1), named_struct('done', '', 'free', 0), (t, i) -> if(i < t.free, t, {step}), t -> t.done)"
    return _one("g", g, _one("s", seps, cut))


def pseudonymize(docs: DataFrame, text_col: str, key: int = 20_260_101, found_col: str = "n_personal") -> DataFrame:
    """``docs`` with personal data in the text replaced, and the number of values replaced.

    Null stays null, with no values; empty and very long texts are texts like any other. Values whose own
    check fails are no personal data and stay. Other columns stay as they are; names with a leading ``__``
    are the operator's own.
    """
    text = F.col(text_col)
    cut = docs.withColumn("__m", F.when(text.rlike("[0-9@=]"), F.expr(f"regexp_extract_all(`{text_col}`, {_lit(ANY)}, 0)")).otherwise(F.array().cast("array<string>")))
    cut = cut.withColumn("__p", F.when(F.size("__m") > 0, F.expr(f"transform(__m, m -> {pseudonym('m', key)})")))
    cut = cut.withColumn("__s", F.when(F.size("__m") > 0, F.expr(f"split(`{text_col}`, {_lit(ANY)}, -1)")))
    joined = F.expr("array_join(flatten(transform(__s, (s, i) -> if(i < size(__p), array(s, __p[i]), array(s)))), '')")
    return cut.withColumn(text_col, F.when(F.size("__m") > 0, joined).otherwise(text)).withColumn(
        found_col, F.when(F.size("__m") > 0, F.expr("size(filter(zip_with(__m, __p, (a, b) -> a <> b), x -> x))")).otherwise(F.lit(0)).cast("long")
    ).drop("__m", "__p", "__s")
