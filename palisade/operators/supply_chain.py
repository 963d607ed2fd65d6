"""Supply chain: suspicious scripts in responses, integrity attributes, content policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.model import DETECTIONS, detection, only
from palisade.rules import java_pattern

# Pattern, name and base score.
SCRIPT_PATTERNS = (
    (r"(?i)coinhive|cryptonight|minero\.cc|coinimp", "Cryptocurrency miner", 9),
    (r"(?i)wasm.*mining|webminer|coin-?hive", "WebAssembly miner", 9),
    (r"(?i)keylog|keystroke|capture.*key", "Keylogger pattern", 8),
    (r"(?i)password.*exfil|cred.*steal", "Credential stealing", 9),
    (r"(?i)\.send\(\s*document\.cookie", "Cookie exfiltration", 8),
    (r"(?i)localStorage\s*\+.*fetch|fetch.*localStorage", "Storage exfiltration", 7),
    (r"""(?i)window\.location\s*=\s*['"]https?://""", "External redirect", 5),
    (r"eval\s*\(\s*atob\s*\(", "Base64 eval", 7),
    (r"eval\s*\(\s*String\.fromCharCode", "CharCode eval", 7),
    (r"\\x[0-9a-fA-F]{2}(\\x[0-9a-fA-F]{2}){10,}", "Hex-encoded payload", 6),
    (r"""(?i)new\s+Function\s*\(\s*['"]""", "Dynamic function creation", 5),
    (r"(?i)document\.write\s*\(\s*unescape", "Unescape write", 6),
    (r"""(?i)createElement\s*\(\s*['"]iframe['"]""", "Dynamic iframe", 5),
    (r"(?i)srcdoc\s*=.*<script", "Iframe script injection", 7),
    (r"(?i)magecart|skimmer|formjack", "Known skimmer", 10),
    (r"(?i)payment.*form.*capture|card.*data.*send", "Payment capture", 9),
)
INLINE_SCRIPT = r"(?is)<script[^>]*>(.*?)</script>"


def script_detections(script: Column, patterns=SCRIPT_PATTERNS) -> Column:
    def of(pattern: str, name: str, base: int) -> Column:
        return F.when(script.rlike(java_pattern(pattern)), detection(92200, f"Suspicious Script: {name}", "Xss", f"Pattern: {name}", "response_body", base, ("supplychain", "script", "suspicious")))

    return only(*[of(*p) for p in patterns])


def inline_scripts(page: Column) -> Column:
    return F.regexp_extract_all(page, F.lit(INLINE_SCRIPT), F.lit(1))


def response_detections(content_type: Column, body: Column) -> Column:
    """The whole body if it is or holds script; for HTML each inline script as well, so that those count twice."""
    low = F.lower(content_type)
    none = F.expr(f"cast(array() as {DETECTIONS})")
    whole = F.when(F.contains(low, F.lit("javascript")) | F.contains(body, F.lit("<script")), script_detections(body)).otherwise(none)
    inner = F.when(F.contains(low, F.lit("html")), F.flatten(F.transform(inline_scripts(body), lambda script: script_detections(script)))).otherwise(none)
    return F.concat(whole, inner)


def integrity(content: Column, bits: int) -> Column:
    """sha256-..., sha384-... or sha512-... of binary or text content."""
    return F.concat(F.lit(f"sha{bits}-"), F.base64(F.unhex(F.sha2(content.cast("binary"), bits))))


def integrity_valid(content: Column, attribute: Column) -> Column:
    """Whether any hash of the attribute fits; hashes of other kinds are skipped."""
    tokens = F.split(F.trim(attribute), r"\s+")
    return F.exists(tokens, lambda t: (t == integrity(content, 256)) | (t == integrity(content, 384)) | (t == integrity(content, 512)))


def policy_issues(policy: Column) -> Column:
    """array<struct(directive, issue, severity)> of a Content-Security-Policy."""
    has = lambda text: F.contains(policy, F.lit(text))
    made = lambda d, i, s: F.struct(F.lit(d).alias("directive"), F.lit(i).alias("issue"), F.lit(s).alias("severity"))
    return only(
        F.when(has("'unsafe-inline'"), made("script-src", "Contains 'unsafe-inline' which allows inline scripts", "Medium")),
        F.when(has("'unsafe-eval'"), made("script-src", "Contains 'unsafe-eval' which allows eval()", "High")),
        F.when(has("script-src *") | has("script-src 'self' *"), made("script-src", "Allows scripts from any source", "Critical")),
        F.when(has("default-src *"), made("default-src", "Allows resources from any source", "High")),
        F.when(~has("script-src") & ~has("default-src"), made("script-src", "Missing script-src directive", "Medium")),
    )


def script_hashes(rows: DataFrame, content: str, allowed: DataFrame, known: DataFrame) -> DataFrame:
    """rows with script_hash (sha256-...) and script_status: allowed (hash in allowed), known good
    (hash in known, with its name as script_name) or unknown. Spark plans the joins."""
    hashed = rows.withColumn("script_hash", integrity(F.col(content), 256))
    allowed = allowed.select(F.col("hash").alias("__allowed")).distinct()
    known = known.groupBy(F.col("hash").alias("__known")).agg(F.min("name").alias("script_name"))
    joined = hashed.join(allowed, F.col("script_hash") == F.col("__allowed"), "left").join(known, F.col("script_hash") == F.col("__known"), "left")
    status = F.when(F.col("__allowed").isNotNull(), "allowed").when(F.col("__known").isNotNull(), "known good").otherwise("unknown")
    return joined.withColumn("script_status", status).withColumn("script_name", F.when(status == "known good", F.col("script_name"))).drop("__allowed", "__known")


def stats(checked: DataFrame) -> DataFrame:
    """script_status, n."""
    return checked.groupBy("script_status").agg(F.count("*").alias("n"))
