"""traversal: detection rules."""

# These must equal the reference's for equal results.
# id, name, attack type, severity, confidence, paranoia level, base score, tags, pattern
RULES = (
    (930100, "Path Traversal: Basic ../ sequence", "PathTraversal", "High", "High", 1, 8, "traversal,lfi", r"\.\.(/|\\)"),
    (930101, "Path Traversal: URL encoded ..%2f", "PathTraversal", "High", "High", 1, 9, "traversal,lfi,encoded", r"(?i)(\.\.%2f|%2e%2e%2f|%2e%2e/|\.%2e/|%2e\./)"),
    (930102, "Path Traversal: Double URL encoded", "PathTraversal", "High", "High", 1, 9, "traversal,lfi,encoded", r"(?i)(%252e%252e|%252f|%255c)"),
    (930103, "Path Traversal: UTF-8 encoded", "PathTraversal", "High", "High", 1, 9, "traversal,lfi,encoded", r"(?i)(%c0%ae|%c1%9c|%c0%af)"),
    (930104, "Path Traversal: Backslash variant", "PathTraversal", "High", "High", 1, 8, "traversal,lfi,windows", r"""\.\.\\"""),
    (930110, "Path Traversal: /etc/passwd access", "PathTraversal", "Critical", "High", 1, 10, "traversal,lfi,unix", r"(?i)/etc/(passwd|shadow|group|hosts)"),
    (930111, "Path Traversal: /proc access", "PathTraversal", "High", "High", 1, 9, "traversal,lfi,unix", r"(?i)/proc/(self|[0-9]+)/(environ|cmdline|fd|maps)"),
    (930112, "Path Traversal: Windows system files", "PathTraversal", "Critical", "High", 1, 10, "traversal,lfi,windows", r"(?i)(c:\\windows|c:\\winnt|c:\\boot\.ini|c:\\system32)"),
    (930113, "Path Traversal: Config file access", "PathTraversal", "High", "High", 1, 9, "traversal,lfi,config", r"(?i)(\.htaccess|\.htpasswd|\.env|wp-config\.php|config\.php)"),
    (930120, "LFI: PHP wrapper php://", "PathTraversal", "Critical", "High", 1, 10, "lfi,rfi,php", r"(?i)php://(input|filter|data)"),
    (930121, "LFI: PHP expect wrapper", "PathTraversal", "Critical", "High", 1, 10, "lfi,rfi,php,rce", r"(?i)expect://"),
    (930122, "LFI: file:// protocol", "PathTraversal", "High", "High", 1, 8, "lfi,file-protocol", r"(?i)file://"),
    (930123, "LFI: Null byte injection", "PathTraversal", "High", "High", 1, 9, "lfi,null-byte", r"(%00|\\x00|\x00)"),
    (930130, "RFI: HTTP include", "PathTraversal", "Critical", "High", 1, 10, "rfi,remote", r"(?i)(file|include|require|page|path|doc|template|folder)=https?://"),
    (930131, "RFI: FTP include", "PathTraversal", "Critical", "High", 1, 10, "rfi,remote", r"(?i)(file|include|require|page)=ftp://"),
    (930140, "LFI: Log file access", "PathTraversal", "High", "Medium", 2, 7, "lfi,log-poisoning", r"(?i)/(var/log|apache|nginx|httpd)/.+\.log"),
    (930150, "Path Traversal: Unicode encoding", "PathTraversal", "Medium", "Low", 3, 5, "traversal,traversal-evasion,pl3", r"(?i)(%u002e|%u2215|%u2216|%uff0e|%uff0f)"),
    (930151, "Path Traversal: Mixed slash encoding", "PathTraversal", "Medium", "Low", 3, 5, "traversal,traversal-evasion,pl3", r"(?i)(\.\.%5c|%5c\.\.|\.\./\\|\\\.\.)"),
    (930152, "Path Traversal: Triple encoding", "PathTraversal", "Medium", "Low", 3, 5, "traversal,traversal-evasion,pl3", r"(?i)(%25252e|%25252f|%25255c)"),
    (930153, "Path Traversal: Dot padding", "PathTraversal", "Medium", "Low", 3, 4, "traversal,traversal-evasion,pl3", r"\.\.\.\./"),
    (930154, "Path Traversal: Encoded null in path", "PathTraversal", "Medium", "Low", 3, 5, "traversal,traversal-evasion,pl3", r"(?i)(%00|%2500).*\.(php|asp|jsp|txt|log)"),
    (930155, "Path Traversal: Tomcat %c0%ae bypass", "PathTraversal", "Medium", "Low", 3, 5, "traversal,traversal-evasion,pl3", r"(?i)%c0(%ae|%2e|%25ae)"),
    (930156, "Path Traversal: Path normalization bypass", "PathTraversal", "Medium", "Low", 3, 4, "traversal,traversal-evasion,pl3", r"""\./\.\./|\.\\\.\.\\"""),
    (930157, "Path Traversal: PHP wrapper variations", "PathTraversal", "Medium", "Low", 3, 5, "lfi,traversal-evasion,pl3", r"(?i)(pHp|PhP)://"),
    (930158, "Path Traversal: Encoded scheme", "PathTraversal", "Medium", "Low", 3, 5, "lfi,traversal-evasion,pl3", r"(?i)(%66%69%6c%65|%46%49%4c%45)://"),
    (930159, "Path Traversal: Java file access", "PathTraversal", "Medium", "Low", 3, 5, "traversal,java,pl3", r"(?i)(WEB-INF|META-INF|classes)/"),
    (930170, "Path Traversal: Any double dot", "PathTraversal", "Low", "Low", 4, 2, "traversal,traversal-generic,pl4", r"\.\."),
    (930171, "Path Traversal: Path separator", "PathTraversal", "Low", "Low", 4, 2, "traversal,traversal-generic,pl4", r"""\\"""),
    (930172, "Path Traversal: Executable extension", "PathTraversal", "Low", "Low", 4, 2, "traversal,traversal-generic,pl4", r"(?i)\.(php|asp|aspx|jsp|cgi|pl|py|rb|sh|exe|bat|cmd)\b"),
    (930173, "Path Traversal: Config file extension", "PathTraversal", "Low", "Low", 4, 2, "traversal,traversal-generic,pl4", r"(?i)\.(conf|config|ini|xml|yaml|yml|json|env)\b"),
    (930174, "Path Traversal: Absolute Unix path", "PathTraversal", "Low", "Low", 4, 2, "traversal,traversal-generic,pl4", r"^/[a-zA-Z]"),
    (930175, "Path Traversal: Drive letter", "PathTraversal", "Low", "Low", 4, 2, "traversal,traversal-generic,pl4", r"(?i)[a-z]:"),
    (930176, "Path Traversal: Hidden files", "PathTraversal", "Low", "Low", 4, 2, "traversal,traversal-generic,pl4", r"/\.[a-zA-Z]"),
    (930177, "Path Traversal: Percent encoding", "PathTraversal", "Low", "Low", 4, 2, "traversal,traversal-generic,pl4", r"(?i)(%2e|%2f|%5c)"),
    (930178, "Path Traversal: URL scheme", "PathTraversal", "Low", "Low", 4, 2, "traversal,traversal-generic,pl4", r"[a-zA-Z]+://"),
    (930179, "Path Traversal: Directory keywords", "PathTraversal", "Low", "Low", 4, 2, "traversal,traversal-generic,pl4", r"(?i)/(etc|var|usr|home|root|tmp|proc|sys|dev|boot|opt)/"),
)
