"""Names, weights and the one detection struct that every operator emits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DETECTION = (
    "struct<rule_id:int,rule_name:string,attack_type:string,matched_value:string,"
    "location:string,base_score:int,tags:array<string>>"
)
DETECTIONS = f"array<{DETECTION}>"

# Display names and weights.
ATTACK_TYPES = {
    "SqlInjection": "SQL Injection",
    "Xss": "Cross-Site Scripting",
    "PathTraversal": "Path Traversal",
    "CommandInjection": "Command Injection",
    "ProtocolAttack": "Protocol Attack",
    "ScannerDetection": "Scanner Detection",
    "RequestSmuggling": "Request Smuggling",
    "Ssti": "Server-Side Template Injection",
    "LdapInjection": "LDAP Injection",
    "XpathInjection": "XPath Injection",
    "Ssrf": "Server-Side Request Forgery",
    "Deserialization": "Insecure Deserialization",
    "DataLeakage": "Data Leakage",
    "Reconnaissance": "Reconnaissance",
    "RemoteCodeExecution": "Remote Code Execution",
    "SupplyChain": "Supply Chain Attack",
}
SEVERITY_WEIGHTS = {"Critical": 2.0, "High": 1.5, "Medium": 1.0, "Low": 0.7, "Info": 0.3}
LOCATION_WEIGHTS = {"path": 1.2, "query": 1.5, "header": 1.0, "cookie": 1.3, "body": 1.2, "websocket": 1.4}


def detection(rule_id, name, attack: str, matched, location, base, tags) -> Column:
    """A detection; plain values become literals."""
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(
        as_column(rule_id).cast("int").alias("rule_id"),
        as_column(name).alias("rule_name"),
        F.lit(ATTACK_TYPES[attack]).alias("attack_type"),
        as_column(matched).alias("matched_value"),
        as_column(location).alias("location"),
        as_column(base).cast("int").alias("base_score"),
        F.array(*[as_column(t) for t in tags]).cast("array<string>").alias("tags"),
    )


def only(*conditional: Column) -> Column:
    """Of detections that may be null, those that are not."""
    return F.array_compact(F.array(*conditional))


def truncated(value: Column, n: int) -> Column:
    """At most n characters, then an ellipsis. Counts characters, so that none is cut in half."""
    return F.when(F.char_length(value) > n, F.concat(F.left(value, F.lit(n)), F.lit("..."))).otherwise(value)
