"""sqli: detection rules."""

# These must equal the reference's for equal results.
# id, name, attack type, severity, confidence, paranoia level, base score, tags, pattern
RULES = (
    (942100, "SQL Injection: UNION SELECT", "SqlInjection", "Critical", "High", 1, 9, "sqli,sqli-union,owasp-top10", r"(?i)\bUNION\b.{0,100}\bSELECT\b"),
    (942101, "SQL Injection: UNION ALL SELECT", "SqlInjection", "Critical", "High", 1, 9, "sqli,sqli-union", r"(?i)\bUNION\s+ALL\b.{0,100}\bSELECT\b"),
    (942102, "SQL Injection: UNION with column count", "SqlInjection", "High", "High", 1, 9, "sqli,sqli-union", r"(?i)\bUNION\b.{0,50}\bSELECT\b.{0,50}(NULL|1)(,\s*(NULL|1)){2,}"),
    (942103, "SQL Injection: SELECT FROM with WHERE", "SqlInjection", "High", "Medium", 1, 7, "sqli,sqli-select", r"(?i)\bSELECT\b.{1,100}\bFROM\b.{1,100}\bWHERE\b"),
    (942104, "SQL Injection: SELECT with information_schema", "SqlInjection", "Critical", "High", 1, 10, "sqli,sqli-enum,database-enum", r"(?i)\bSELECT\b.{0,100}(information_schema|mysql\.user|sys\.)"),
    (942105, "SQL Injection: UNION with ORDER BY", "SqlInjection", "High", "Medium", 1, 7, "sqli,sqli-union", r"(?i)(\bUNION\b|\bORDER\s+BY\b)\s+\d+"),
    (942110, "SQL Injection: SELECT with concat", "SqlInjection", "Medium", "Medium", 2, 6, "sqli,sqli-select", r"(?i)\bSELECT\b.{0,50}(CONCAT|GROUP_CONCAT)\s*\("),
    (942111, "SQL Injection: UNION with comments", "SqlInjection", "High", "Medium", 2, 8, "sqli,sqli-union,sqli-evasion", r"(?i)\bUNION\b\s*/\*.*\*/\s*\bSELECT\b"),
    (942112, "SQL Injection: Case variation evasion", "SqlInjection", "Medium", "Low", 3, 5, "sqli,sqli-evasion", r"(?-i)(uNiOn|UnIoN|sElEcT|SeLeCt|FrOm|WhErE)"),
    (942113, "SQL Injection: URL-encoded UNION", "SqlInjection", "High", "High", 2, 8, "sqli,sqli-union,sqli-encoded", r"(?i)(%55%4e%49%4f%4e|%75%6e%69%6f%6e)"),
    (942114, "SQL Injection: Double URL-encoded UNION", "SqlInjection", "High", "High", 2, 8, "sqli,sqli-union,sqli-encoded", r"(?i)(%2555%254e%2549%254f%254e)"),
    (942120, "SQL Injection: DROP statement", "SqlInjection", "Critical", "High", 1, 10, "sqli,sqli-destructive", r"(?i);\s*DROP\s+(TABLE|DATABASE|INDEX|VIEW)\s+"),
    (942121, "SQL Injection: DELETE statement", "SqlInjection", "Critical", "High", 1, 10, "sqli,sqli-destructive", r"(?i);\s*DELETE\s+FROM\s+"),
    (942122, "SQL Injection: UPDATE statement", "SqlInjection", "High", "High", 1, 9, "sqli,sqli-destructive", r"(?i);\s*UPDATE\s+\w+\s+SET\s+"),
    (942123, "SQL Injection: INSERT statement", "SqlInjection", "High", "High", 1, 9, "sqli,sqli-destructive", r"(?i);\s*INSERT\s+INTO\s+"),
    (942124, "SQL Injection: ALTER statement", "SqlInjection", "Critical", "High", 1, 10, "sqli,sqli-destructive", r"(?i);\s*ALTER\s+(TABLE|DATABASE)\s+"),
    (942125, "SQL Injection: TRUNCATE statement", "SqlInjection", "Critical", "High", 1, 10, "sqli,sqli-destructive", r"(?i);\s*TRUNCATE\s+(TABLE\s+)?\w+"),
    (942130, "SQL Injection: EXTRACTVALUE/UPDATEXML", "SqlInjection", "Critical", "High", 1, 9, "sqli,sqli-error,mysql", r"(?i)(EXTRACTVALUE|UPDATEXML)\s*\("),
    (942131, "SQL Injection: CONVERT/CAST error", "SqlInjection", "High", "Medium", 2, 7, "sqli,sqli-error", r"(?i)(CONVERT|CAST)\s*\(.+\s+AS\s+(INT|VARCHAR|CHAR)"),
    (942132, "SQL Injection: EXP/FLOOR error overflow", "SqlInjection", "High", "High", 2, 8, "sqli,sqli-error,mysql", r"(?i)(EXP|FLOOR)\s*\(\s*(RAND|SELECT)"),
    (942133, "SQL Injection: XMLType error (Oracle)", "SqlInjection", "High", "High", 2, 8, "sqli,sqli-error,oracle", r"(?i)XMLType\s*\(\s*\("),
    (942140, "SQL Injection: xp_cmdshell", "SqlInjection", "Critical", "High", 1, 10, "sqli,sqli-rce,mssql", r"(?i)xp_cmdshell"),
    (942141, "SQL Injection: sp_executesql", "SqlInjection", "High", "Medium", 2, 7, "sqli,mssql", r"(?i)(sp_executesql|EXEC\s*\()"),
    (942145, "SQL Injection: PostgreSQL COPY", "SqlInjection", "Critical", "High", 1, 10, "sqli,sqli-file,postgresql", r"(?i)COPY\s+\w+\s+(FROM|TO)\s+"),
    (942146, "SQL Injection: PostgreSQL lo_export", "SqlInjection", "Critical", "High", 1, 10, "sqli,sqli-file,postgresql", r"(?i)(lo_export|lo_import)\s*\("),
    (942150, "SQL Injection: Tautology OR 1=1", "SqlInjection", "High", "High", 1, 9, "sqli,sqli-blind,sqli-boolean", r"""(?i)['"]\s*OR\s*['"]?1['"]?\s*=\s*['"]?1"""),
    (942151, "SQL Injection: Tautology OR true", "SqlInjection", "High", "High", 1, 9, "sqli,sqli-blind,sqli-boolean", r"""(?i)['"]\s*OR\s+(true|'a'\s*=\s*'a')"""),
    (942152, "SQL Injection: AND 1=1 test", "SqlInjection", "Medium", "Medium", 1, 7, "sqli,sqli-blind,sqli-boolean", r"""(?i)\bAND\b\s*['"]?\d+['"]?\s*=\s*['"]?\d+"""),
    (942153, "SQL Injection: Boolean substring test", "SqlInjection", "High", "High", 2, 8, "sqli,sqli-blind,sqli-boolean", r"""(?i)(SUBSTRING|SUBSTR|MID)\s*\(.+\)\s*=\s*['\"]"""),
    (942154, "SQL Injection: Boolean ASCII test", "SqlInjection", "High", "High", 2, 8, "sqli,sqli-blind,sqli-boolean", r"(?i)(ASCII|ORD)\s*\(.+\)\s*(=|>|<|>=|<=)\s*\d+"),
    (942155, "SQL Injection: CASE WHEN blind", "SqlInjection", "High", "High", 2, 7, "sqli,sqli-blind", r"(?i)CASE\s+WHEN\s+.+\s+THEN\s+.+\s+ELSE\s+.+\s+END"),
    (942156, "SQL Injection: IF condition blind", "SqlInjection", "High", "Medium", 2, 6, "sqli,sqli-blind", r"(?i)\bIF\s*\(\s*.+,\s*.+,\s*.+\)"),
    (942160, "SQL Injection: SLEEP function", "SqlInjection", "Critical", "High", 1, 9, "sqli,sqli-blind,sqli-time,mysql", r"(?i)SLEEP\s*\(\s*\d+"),
    (942161, "SQL Injection: BENCHMARK function", "SqlInjection", "Critical", "High", 1, 9, "sqli,sqli-blind,sqli-time,mysql", r"(?i)BENCHMARK\s*\(\s*\d+"),
    (942162, "SQL Injection: WAITFOR DELAY", "SqlInjection", "Critical", "High", 1, 9, "sqli,sqli-blind,sqli-time,mssql", r"(?i)WAITFOR\s+(DELAY|TIME)"),
    (942163, "SQL Injection: pg_sleep", "SqlInjection", "Critical", "High", 1, 9, "sqli,sqli-blind,sqli-time,postgresql", r"(?i)pg_sleep\s*\(\s*\d+"),
    (942164, "SQL Injection: DBMS_LOCK.SLEEP", "SqlInjection", "Critical", "High", 1, 9, "sqli,sqli-blind,sqli-time,oracle", r"(?i)DBMS_LOCK[.]SLEEP"),
    (942170, "SQL Injection: Greater/Less comparison", "SqlInjection", "Low", "Low", 3, 3, "sqli,sqli-blind", r"""(?i)['"]?\s*(>|<|>=|<=|<>|!=)\s*['"]?\d+"""),
    (942171, "SQL Injection: LIKE pattern", "SqlInjection", "Low", "Low", 3, 2, "sqli,sqli-blind", r"""(?i)\bLIKE\s*['"][%_]"""),
    (942180, "SQL Injection: Comment termination", "SqlInjection", "Medium", "Medium", 2, 6, "sqli,sqli-comment", r"""(?i)(['"]\s*(-{2}|#|/\*)|(-{2}|#|/\*)\s*['"$])"""),
    (942181, "SQL Injection: Inline comment", "SqlInjection", "Medium", "Low", 2, 4, "sqli,sqli-comment", r"/\*[^*]*\*/"),
    (942182, "SQL Injection: MySQL version comment", "SqlInjection", "High", "High", 2, 8, "sqli,sqli-comment,mysql", r"/\*!\d{5}"),
    (942185, "SQL Injection: Semicolon stacking", "SqlInjection", "High", "Medium", 1, 8, "sqli,sqli-stacked", r"(?i);\s*(SELECT|INSERT|UPDATE|DELETE|DROP|ALTER|CREATE|TRUNCATE)"),
    (942186, "SQL Injection: Multiple statements", "SqlInjection", "Medium", "Low", 3, 5, "sqli,sqli-stacked", r"(?i)(SELECT|INSERT|UPDATE|DELETE).{5,100};.{0,20}(SELECT|INSERT|UPDATE|DELETE)"),
    (942190, "SQL Injection: String escape", "SqlInjection", "Medium", "Medium", 2, 5, "sqli,sqli-escape", r"""(\\x27|\\x22|%27|%22|''|"")"""),
    (942191, "SQL Injection: Quote balance attack", "SqlInjection", "Medium", "Low", 3, 4, "sqli,sqli-escape", r"^[^']*'[^']*'[^']*'[^']*$"),
    (942195, "SQL Injection: Hex encoded string", "SqlInjection", "High", "High", 2, 7, "sqli,sqli-encoded", r"(?i)0x[0-9a-f]{8,}"),
    (942196, "SQL Injection: CHAR function", "SqlInjection", "High", "High", 2, 8, "sqli,sqli-encoded", r"(?i)CHAR\s*\(\s*\d+(\s*,\s*\d+)+\s*\)"),
    (942197, "SQL Injection: CHR function (Oracle)", "SqlInjection", "High", "High", 2, 8, "sqli,sqli-encoded,oracle", r"(?i)CHR\s*\(\s*\d+\s*\)(\s*\|\|\s*CHR\s*\(\s*\d+\s*\))+"),
    (942200, "NoSQL Injection: MongoDB operator", "SqlInjection", "Critical", "High", 1, 9, "nosql,mongodb", r"(?i)(\$where|\$gt|\$lt|\$ne|\$eq|\$regex|\$exists|\$or|\$and|\$in|\$nin)"),
    (942201, "NoSQL Injection: MongoDB $where JS", "SqlInjection", "Critical", "High", 1, 10, "nosql,mongodb,rce", r"""(?i)\$where\s*:\s*['\"]?function\s*\("""),
    (942202, "NoSQL Injection: MongoDB mapReduce", "SqlInjection", "Critical", "High", 1, 10, "nosql,mongodb,rce", r"(?i)(mapReduce|map_reduce)\s*\("),
    (942203, "NoSQL Injection: MongoDB $regex DoS", "SqlInjection", "High", "Medium", 2, 7, "nosql,mongodb,dos", r"""(?i)\$regex\s*:\s*['\"].*(\*\+|\+\*|\{\d+,\})"""),
    (942204, "NoSQL Injection: JSON operator injection", "SqlInjection", "High", "Medium", 2, 7, "nosql,json", r"""\{\s*['\"]?\$[a-z]+['\"]?\s*:"""),
    (942210, "NoSQL Injection: Redis command", "SqlInjection", "Critical", "High", 1, 10, "nosql,redis", r"(?i)\b(EVAL|EVALSHA|CONFIG|FLUSHALL|FLUSHDB|DEBUG|SHUTDOWN|SLAVEOF|REPLICAOF)\b"),
    (942211, "NoSQL Injection: Redis Lua script", "SqlInjection", "Critical", "High", 1, 10, "nosql,redis,lua", r"(?i)(redis\.call|redis\.pcall)\s*\("),
    (942220, "NoSQL Injection: CouchDB view", "SqlInjection", "High", "Medium", 2, 7, "nosql,couchdb", r"(?i)_design/.*/_view/"),
    (942230, "NoSQL Injection: Cassandra CQL", "SqlInjection", "High", "Medium", 2, 6, "nosql,cassandra", r"(?i)\b(ALLOW\s+FILTERING|TOKEN\s*\(|USING\s+TTL)\b"),
    (942240, "NoSQL Injection: Elasticsearch script", "SqlInjection", "Critical", "High", 1, 9, "nosql,elasticsearch,rce", r'(?i)("script"\s*:\s*\{|_scripts/|painless|groovy)'),
    (942241, "NoSQL Injection: Elasticsearch _search", "SqlInjection", "Medium", "Low", 3, 4, "nosql,elasticsearch", r"(?i)/_search\?"),
)
