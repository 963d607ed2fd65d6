"""Sensitive data in text: cards, social security numbers, keys, private keys, bulk e-mail."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palisade.functions.binding import scanned
from palisade.model import detection
from palisade.rules import java_pattern

# Patterns and the order in which they are tried.
CARD = r"\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}|3(?:0[0-5]|[68][0-9])[0-9]{11}|6(?:011|5[0-9]{2})[0-9]{12}|(?:2131|1800|35\d{3})\d{11})\b"
CARD_SEPARATED = r"\b(?:4[0-9]{3}[-\s]?[0-9]{4}[-\s]?[0-9]{4}[-\s]?[0-9]{4}|5[1-5][0-9]{2}[-\s]?[0-9]{4}[-\s]?[0-9]{4}[-\s]?[0-9]{4}|3[47][0-9]{2}[-\s]?[0-9]{6}[-\s]?[0-9]{5})\b"
SSN = r"\b\d{3}[-\s]?\d{2}[-\s]?\d{4}\b"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
API_KEYS = (
    ("AWS", r"(?:A3T[A-Z0-9]|AKIA|AGPA|AIDA|AROA|AIPA|ANPA|ANVA|ASIA)[A-Z0-9]{16}"),
    ("AWS Secret", r"""(?i)aws.{0,20}['"]\s*[A-Za-z0-9/+=]{40}\s*['"]"""),
    ("Google", r"AIza[0-9A-Za-z_-]{35}"),
    ("GitHub", r"gh[pousr]_[A-Za-z0-9_]{36,255}"),
    ("GitHub PAT", r"github_pat_[A-Za-z0-9_]{22,255}"),
    ("Slack", r"xox[baprs]-[0-9]{10,13}-[0-9]{10,13}[a-zA-Z0-9-]*"),
    ("Stripe", r"sk_(live|test)_[0-9a-zA-Z]{24,}"),
    ("Stripe Public", r"pk_(live|test)_[0-9a-zA-Z]{24,}"),
    ("Twilio", r"SK[0-9a-fA-F]{32}"),
    ("SendGrid", r"SG\.[a-zA-Z0-9_-]{22}\.[a-zA-Z0-9_-]{43}"),
    ("Mailchimp", r"[a-f0-9]{32}-us[0-9]{1,2}"),
    ("Square", r"sq0[a-z]{3}-[0-9A-Za-z_-]{22,43}"),
    ("PayPal", r"access_token\$production\$[a-z0-9]{16}\$[a-f0-9]{32}"),
    ("UUID/Heroku", r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"),
    ("Generic API", r"""(?i)api[_-]?key['"]?\s*[:=]\s*['"]?[a-zA-Z0-9_-]{20,}['"]?"""),
    ("Generic Secret", r"""(?i)(?:secret|password|passwd|pwd)[_-]?['"]?\s*[:=]\s*['"]?[^\s'"]{8,}['"]?"""),
)
PRIVATE_KEYS = (
    ("RSA", "-----BEGIN RSA PRIVATE KEY-----"),
    ("DSA", "-----BEGIN DSA PRIVATE KEY-----"),
    ("EC", "-----BEGIN EC PRIVATE KEY-----"),
    ("OpenSSH", "-----BEGIN OPENSSH PRIVATE KEY-----"),
    ("PGP", "-----BEGIN PGP PRIVATE KEY BLOCK-----"),
    ("PKCS8", "-----BEGIN PRIVATE KEY-----"),
    ("Encrypted PKCS8", "-----BEGIN ENCRYPTED PRIVATE KEY-----"),
)
BULK_EMAILS = 10


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(java_pattern(pattern)), F.lit(0))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """13 to 19 digits whose check digit is right."""
    return F.char_length(number).between(13, 19) & F.call_function("luhn_check", number)


def card_brand(number: Column) -> Column:
    starts = lambda *heads: F.regexp_like(number, F.lit(f"^(?:{'|'.join(heads)})"))
    return (
        F.when(starts("4"), "Visa")
        .when(starts("5[1-5]"), "Mastercard")
        .when(starts("34", "37"), "American Express")
        .when(starts("6011", "65"), "Discover")
        .when(starts("35"), "JCB")
        .when(starts("30", "36", "38"), "Diners Club")
        .otherwise("Unknown")
    )


def valid_ssn(number: Column) -> Column:
    area, group, serial = (F.substring(number, a, n).cast("int") for a, n in ((1, 3), (4, 2), (6, 4)))
    return (F.char_length(number) == 9) & (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)


def mask_card(number: Column) -> Column:
    return F.when(F.char_length(number) < 4, "****").otherwise(F.concat(F.lit("****-****-****-"), F.right(number, F.lit(4))))


def mask_ssn(number: Column) -> Column:
    return F.when(F.char_length(number) < 4, "***-**-****").otherwise(F.concat(F.lit("***-**-"), F.right(number, F.lit(4))))


def mask_key(key: Column) -> Column:
    return F.when(F.char_length(key) <= 8, "********").otherwise(F.concat(F.left(key, F.lit(4)), F.lit("..."), F.right(key, F.lit(4))))


def _cards(text: Column, pattern: str, rule_id: int, name: str, location: str) -> Column:
    good = F.filter(F.transform(matches(text, pattern), digits), luhn)
    return F.transform(
        good, lambda n: detection(rule_id, F.concat(F.lit(f"{name} Detected: "), card_brand(n)), "DataLeakage", mask_card(n), location, 9, ("sensitive-data", "credit-card", "pci"))
    )


def scan(text: Column, location: str = "response_body", bulk: int = BULK_EMAILS) -> Column:
    """Detections in the order cards, separated cards, numbers, keys, private keys, e-mail.

    A card without separators can match both card patterns and is then reported by both."""
    found = [_cards(text, CARD, 95001, "Credit Card", location), _cards(text, CARD_SEPARATED, 95002, "Credit Card (Formatted)", location)]
    numbers = F.filter(F.transform(matches(text, SSN), digits), valid_ssn)
    found.append(F.transform(numbers, lambda n: detection(95100, "Social Security Number Detected", "DataLeakage", mask_ssn(n), location, 9, ("sensitive-data", "ssn", "pii"))))
    for provider, pattern in API_KEYS:
        name, tags = f"API Key Detected: {provider}", ("sensitive-data", "api-key", provider.lower())
        found.append(_keys(text, pattern, name, tags, location))
    for kind, header in PRIVATE_KEYS:
        one = detection(95300, f"Private Key Detected: {kind}", "DataLeakage", f"-----BEGIN {kind} PRIVATE KEY-----", location, 10, ("sensitive-data", "private-key", "critical"))
        found.append(F.when(F.contains(text, F.lit(header)), F.array(one)).otherwise(F.slice(F.array(one), 1, 0)))
    n = F.size(matches(text, EMAIL))
    mail = detection(95101, "Bulk Email Exposure", "DataLeakage", F.concat(n.cast("string"), F.lit(" email addresses detected")), location, 7, ("sensitive-data", "email", "pii"))
    found.append(F.when(n >= bulk, F.array(mail)).otherwise(F.slice(F.array(mail), 1, 0)))
    return F.concat(*found)


def _keys(text: Column, pattern: str, name: str, tags: tuple[str, ...], location: str) -> Column:
    return F.transform(matches(text, pattern), lambda k: detection(95200, name, "DataLeakage", mask_key(k), location, 8, tags))


def _placed(text: Column, pattern: str) -> Column:
    """array<struct(value, position)> of every match; positions are in bytes."""
    found = matches(text, pattern)
    gaps = F.slice(F.split(text, java_pattern(pattern), -1), 1, F.size(found))

    def add(at: Column, pair: Column) -> tuple[Column, Column]:
        start = at + F.octet_length(pair["gap"])
        return start + F.octet_length(pair["value"]), F.struct(pair["value"].alias("value"), start.alias("position"))

    return scanned(F.arrays_zip(gaps.alias("gap"), found.alias("value")), F.lit(0), add, "struct<value:string,position:int>")


def scan_detailed(text: Column) -> Column:
    """array<struct(data_type, detail, masked, position)>: cards without separators, social security
    numbers, API keys and, each once, private keys; position is the byte where a match begins."""
    made = lambda kind, detail, masked, position: F.struct(
        F.lit(kind).alias("data_type"), detail.alias("detail"), masked.alias("masked"), position.cast("int").alias("position")
    )
    nothing = F.lit(None).cast("string")
    cards = F.filter(_placed(text, CARD), lambda x: luhn(x["value"]))
    numbers = F.filter(_placed(text, SSN), lambda x: valid_ssn(digits(x["value"])))
    found = [
        F.transform(cards, lambda x: made("credit card", card_brand(x["value"]), mask_card(x["value"]), x["position"])),
        F.transform(numbers, lambda x: made("social security number", nothing, mask_ssn(x["value"]), x["position"])),
    ]
    of_key = lambda provider: lambda x: made("api key", F.lit(provider), mask_key(x["value"]), x["position"])
    found += [F.transform(_placed(text, pattern), of_key(provider)) for provider, pattern in API_KEYS]
    for kind, header in PRIVATE_KEYS:
        one = made("private key", F.lit(kind), F.lit(f"-----BEGIN {kind} PRIVATE KEY-----"), F.octet_length(F.substring_index(text, header, 1)))
        found.append(F.when(F.contains(text, F.lit(header)), F.array(one)).otherwise(F.slice(F.array(one), 1, 0)))
    return F.concat(*found)
