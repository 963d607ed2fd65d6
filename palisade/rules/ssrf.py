"""ssrf: detection rules."""

# These must equal the reference's for equal results.
# id, name, attack type, severity, confidence, paranoia level, base score, tags, pattern
RULES = (
    (936100, "SSRF: AWS metadata endpoint", "Ssrf", "Critical", "High", 1, 10, "ssrf,cloud,aws", r"(?i)(169\.254\.169\.254|metadata\.google\.internal|metadata\.azure\.com)"),
    (936101, "SSRF: AWS IMDSv1 path", "Ssrf", "Critical", "High", 1, 10, "ssrf,cloud,aws", r"(?i)/latest/(meta-data|user-data|api/token)"),
    (936102, "SSRF: GCP metadata", "Ssrf", "Critical", "High", 1, 10, "ssrf,cloud,gcp", r"(?i)/computeMetadata/v1/"),
    (936103, "SSRF: DigitalOcean metadata", "Ssrf", "Critical", "High", 1, 10, "ssrf,cloud,digitalocean", r"(?i)169\.254\.169\.254/metadata/v1/"),
    (936110, "SSRF: Private IP 10.x.x.x", "Ssrf", "High", "Medium", 1, 8, "ssrf,internal-ip", r"(?i)(https?://|@)10\.\d{1,3}\.\d{1,3}\.\d{1,3}"),
    (936111, "SSRF: Private IP 172.16-31.x.x", "Ssrf", "High", "Medium", 1, 8, "ssrf,internal-ip", r"(?i)(https?://|@)172\.(1[6-9]|2[0-9]|3[0-1])\.\d{1,3}\.\d{1,3}"),
    (936112, "SSRF: Private IP 192.168.x.x", "Ssrf", "High", "Medium", 1, 8, "ssrf,internal-ip", r"(?i)(https?://|@)192\.168\.\d{1,3}\.\d{1,3}"),
    (936113, "SSRF: Localhost access", "Ssrf", "High", "High", 1, 9, "ssrf,localhost", r"(?i)(https?://|@)(localhost|127\.0\.0\.1|0\.0\.0\.0|\[::1\]|0177\.)"),
    (936114, "SSRF: IPv6 loopback", "Ssrf", "High", "High", 1, 9, "ssrf,localhost,ipv6", r"(?i)(https?://|@)\[?::1\]?"),
    (936120, "SSRF: file:// protocol", "Ssrf", "Critical", "High", 1, 10, "ssrf,file-protocol", r"(?i)file://"),
    (936121, "SSRF: gopher:// protocol", "Ssrf", "Critical", "High", 1, 10, "ssrf,gopher", r"(?i)gopher://"),
    (936122, "SSRF: dict:// protocol", "Ssrf", "High", "High", 1, 8, "ssrf,dict", r"(?i)dict://"),
    (936130, "SSRF: Octal IP encoding", "Ssrf", "High", "High", 2, 8, "ssrf,encoding", r"(?i)(https?://|@)0[0-7]+\.0[0-7]+\.0[0-7]+\.0[0-7]+"),
    (936131, "SSRF: Decimal IP encoding", "Ssrf", "High", "Medium", 2, 7, "ssrf,encoding", r"(?i)(https?://|@)\d{8,10}(:|/|$)"),
    (936132, "SSRF: Hex IP encoding", "Ssrf", "High", "High", 2, 8, "ssrf,encoding", r"(?i)(https?://|@)0x[0-9a-f]+\."),
)
