"""Column expressions over text: merchants, redaction, parsing of German formats, evidence kinds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What is redacted from mail texts, in order, and what takes its place.
REDACTIONS = [
    (r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", "[email]"),
    (r"\bDE\d{20}\b", "DE[iban]"),
    (r"\b[A-Z]{2}\d{2}[A-Z0-9]{10,30}\b", "[iban]"),
    (r"(?i)\b(order|bestell(?:ung|nummer)?|invoice|rechnung(?:snummer)?|ref)[\s:#-]*[A-Z0-9][A-Z0-9._/-]{3,}\b", "$1 [ref]"),
    (r"\b\d{7,}\b", "[number]"),
]
#: Fixed value: what a text must hold for any of these to match.
REDACTABLE = r"(?i)[@0-9]|order|bestell|invoice|rechnung|ref"
#: The same for texts that go to a language model; here a reference needs a digit.
SANITISERS = [
    (r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", "[email]"),
    (r"\bDE\d{20}\b", "DE[iban]"),
    (r"\b[A-Z]{2}\d{2}[A-Z0-9]{10,30}\b", "[iban]"),
    (r"(?i)\bBearer\s+[A-Za-z0-9\-_\.~+/=]{8,}", "Bearer [token]"),
    (r"(?i)\b(mandat|mandate|reference|referenz|endtoend|order|invoice)[\s:#-]*[A-Z0-9][A-Z0-9._/-]*\d[A-Z0-9._/-]*\b", "$1 [ref]"),
    (r"\b\d{9,}\b", "[number]"),
]
#: Legal forms and the like that are no part of a merchant's name.
LEGAL_FORMS = r"\b(gmbh|ag|inc|ltd|co\.?|kg|se|eu|payments?)\b"
#: Patterns and words of each kind of evidence, the first that fits counting; and of payment methods.
EVIDENCE_TYPES = [("refund", r"\b(?:refund(?:ed)?|rückerstattung|erstattung|erstattet|gutschrift)\b"), ("subscription", "subscription|abo|verlängerung"), ("receipt", "receipt|quittung|beleg|kassenbon"), ("invoice", "invoice|rechnung")]
PAYMENT_METHODS = [("paypal", "paypal"), ("credit_card", "visa|mastercard|kreditkarte|credit card"), ("direct_debit", "sepa|lastschrift|direct debit"), ("invoice", "kauf auf rechnung|zahlungsart: invoice|payment method: invoice")]


def _blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def _replaced(c: Column, rules: list[tuple[str, str]], limit: int) -> Column:
    return _squeezed(reduce(lambda x, rule: F.regexp_replace(x, *rule), rules, c), limit)


def _squeezed(c: Column, limit: int) -> Column:
    return F.left(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(limit))


def redact(c: Column, limit: int = 500) -> Column:
    """Free text without addresses, account numbers, references and long numbers; null if nothing is left."""
    replaced = reduce(lambda x, rule: F.regexp_replace(x, *rule), REDACTIONS, c)
    return _blank_to_null(_squeezed(F.when(c.rlike(REDACTABLE), replaced).otherwise(c), limit))


def sanitise(c: Column, limit: int = 300) -> Column:
    """Text fit for a language model's prompt."""
    return _replaced(c, SANITISERS, limit)


def web_query(c: Column, limit: int = 80) -> Column:
    """A sanitised text as a search query: without marks and unusual characters."""
    bare = F.regexp_replace(F.regexp_replace(sanitise(c), r"(?:\bDE)?\[[a-z]+\]", " "), r"[^\p{L}\p{N} .&+-]", " ")
    return F.left(F.trim(F.regexp_replace(bare, r"\s+", " ")), F.lit(limit))


def is_unsafe(c: Column) -> Column:
    """Whether anything that must not leave the house is still in a text."""
    return reduce(lambda a, b: a | b, [c.rlike(pattern) for pattern, _ in SANITISERS])


def merchant_key(c: Column) -> Column:
    """A merchant's name as a key: lower case, without processor prefix, legal form and punctuation."""
    plain = F.regexp_replace(F.replace(F.lower(c), F.lit("paypal *"), F.lit(" ")), LEGAL_FORMS, " ")
    return _blank_to_null(F.trim(F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9äöüß]+", " "), r"\s+", " ")))


def strip_processor(c: Column) -> Column:
    return F.regexp_replace(c, r"(?i)^\s*(?:paypal|pp)\s*\*\s*", "")


def haystack(*columns: Column) -> Column:
    """Lower-case text that rules search: empty slots keep their space."""
    return F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in columns]))


def evidence_type(c: Column) -> Column:
    low = F.lower(c)
    return F.coalesce(*[F.when(low.rlike(p), kind) for kind, p in EVIDENCE_TYPES], F.lit("order"))


def payment_method(c: Column) -> Column:
    low = F.lower(c)
    return F.coalesce(*[F.when(low.rlike(p), kind) for kind, p in PAYMENT_METHODS])


def german_decimal(c: Column, scale: int = 2) -> Column:
    """``-1.234,56`` as a decimal; several points and no comma are thousands; empty is 0, what cannot be read is null."""
    t = F.regexp_replace(c, "[\\s ]", "")
    points = F.length(t) - F.length(F.replace(t, F.lit("."), F.lit("")))
    plain = F.when(F.contains(t, F.lit(",")), F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).when(points > 1, F.replace(t, F.lit("."), F.lit(""))).otherwise(t)
    return F.when(t == "", F.lit(0)).otherwise(plain.try_cast("decimal(38,10)")).cast(f"decimal(14,{scale})")


def mixed_decimal(c: Column) -> Column:
    """A decimal in either locale: with comma and point German, with a comma alone decimal comma; else as it is."""
    t = F.trim(c)
    german = F.contains(t, F.lit(",")) & F.contains(t, F.lit("."))
    return F.bround(F.when(german, F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(t, F.lit(","), F.lit("."))).try_cast("decimal(38,10)"), 2).cast("decimal(14,2)")


def any_date(c: Column) -> Column:
    """ISO, d.m.Y or d/m/Y."""
    return F.coalesce(*[F.try_to_date(c, f) for f in ("yyyy-MM-dd", "d.M.yyyy", "d/M/yyyy")])


def remittance(c: Column) -> Column:
    """Bank text in chunks of 37 characters, two digits before each: the parts without them, joined by commas."""
    parts = F.transform(F.sequence(F.lit(1), F.length(c), F.lit(37)), lambda i: F.trim(F.regexp_replace(F.substr(c, i, F.lit(37)), r"^\d{2}", "")))
    return F.when(F.startswith(c, F.lit("01")) & (F.length(c) >= 37), F.array_join(F.filter(parts, lambda p: p != ""), ", ")).otherwise(F.trim(c))


def iban(c: Column) -> Column:
    """An account number in its plain form; null if it has not the shape of one."""
    plain = F.upper(F.replace(c, F.lit(" "), F.lit("")))
    return F.when(plain.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{10,30}$"), plain)


def reference_hash(c: Column) -> Column:
    return F.sha2(F.lower(F.trim(c)), 256)


#: Fixed value: the namespace of URLs in RFC 9562.
URL_NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"


def uuid5(name: Column, namespace: str = URL_NAMESPACE) -> Column:
    """The version 5 UUID of ``name``; null for null."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.substr(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def shortened(c: Column, limit: int = 50) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.left(c, F.lit(limit - 3)), F.lit("..."))).otherwise(c)


def german_money(c: Column, unit: str = " EUR") -> Column:
    return F.concat(F.translate(F.format_number(c, 2), ",.", ".,"), F.lit(unit))


def html_text(c: Column) -> Column:
    """Readable text of HTML: no scripts, styles, comments or tags; the usual entities decoded, white space collapsed."""
    out = F.regexp_replace(F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"<[^>]+>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def line_items(c: Column, most: int = 30) -> Column:
    """``- label | amount | hint`` lines as structs."""
    lines = F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(x)), lambda x: x.rlike(r"^[-*].*\|"))
    parts = F.transform(lines, lambda x: F.transform(F.split(F.substr(x, F.lit(2)), r"\|"), lambda y: F.trim(y)))
    items = F.transform(F.filter(parts, lambda p: p[0] != ""), lambda p: F.struct(F.coalesce(redact(p[0], 120), F.lit("Artikel")).alias("label"), mixed_decimal(F.get(p, 1)).alias("amount"), redact(F.get(p, 2), 80).alias("category_hint")))
    return F.slice(items, 1, most)


#: Fixed value: keys whose values never go to a language model.
BANNED_KEYS = r"(?i)(iban|raw|source_payload|account_id|depot_id|external_id|mandate|reference|order|invoice|message_id|token|password|webhook|database_url|email)"


def masked_url(url: Column) -> Column:
    """A web hook's address without the secret at its end but for the last six characters."""
    bare = F.regexp_replace(url, "/+$", "")
    head, tail = F.regexp_extract(bare, "^(.+/)[^/]*$", 1), F.regexp_extract(bare, "([^/]*)$", 1)
    return F.when(head == "", url).when(F.length(tail) <= 6, F.concat(head, F.lit("…"))).otherwise(F.concat(head, F.lit("…"), F.right(tail, F.lit(6))))


#: What raw error messages hold, and what a user is told instead; the first that fits counts.
ERRORS = [
    (r"(?i)specified api usage limits|(?=.*invalid_request_error)(?=.*usage limit)", "limit reached"),
    (r"(?i)rate_limit|429", "too many requests"),
    (r"(?i)connect", "no connection"),
    (r"(?i)exceeded maximum retries", "malformed answers"),
]


def error_class(message: Column) -> Column:
    return F.coalesce(*[F.when(message.rlike(p), name) for p, name in ERRORS], message)
