"""xpath: detection rules."""

# These must equal the reference's for equal results.
# id, name, attack type, severity, confidence, paranoia level, base score, tags, pattern
RULES = (
    (934100, "XPath Injection: Boolean true", "XpathInjection", "High", "High", 1, 8, "xpath,boolean", r"(?i)'\s*or\s*'[^']*'\s*=\s*'"),
    (934101, "XPath Injection: XPath functions", "XpathInjection", "High", "High", 1, 7, "xpath,function", r"(?i)(substring|string-length|normalize-space|translate|concat)\s*\("),
    (934102, "XPath Injection: Axis traversal", "XpathInjection", "High", "High", 1, 7, "xpath,traversal", r"(?i)(ancestor|child|descendant|following|parent|preceding|self)::"),
    (934103, "XPath Injection: Position predicate", "XpathInjection", "Medium", "Medium", 2, 5, "xpath,predicate", r"\[position\(\)\s*(=|>|<)\s*\d+\]"),
    (934104, "XPath Injection: Node extraction", "XpathInjection", "High", "High", 1, 8, "xpath,extraction", r"(?i)(/\*|\.\.|//\*|/child::\*)"),
    (934105, "XPath Injection: Contains function", "XpathInjection", "Medium", "Medium", 2, 5, "xpath,blind", r"(?i)contains\s*\([^)]+,[^)]+\)"),
)
