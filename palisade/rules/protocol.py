"""protocol: detection rules."""

# These must equal the reference's for equal results.
# id, name, attack type, severity, confidence, paranoia level, base score, tags, pattern
RULES = (
    (920100, "Protocol: Control characters in request", "ProtocolAttack", "High", "High", 1, 8, "protocol,malformed", r"[\x00-\x08\x0b\x0c\x0e-\x1f]"),
    (920101, "Protocol: Null byte in request", "ProtocolAttack", "High", "High", 1, 8, "protocol,null-byte", r"(%00|\x00)"),
    (920110, "Request Smuggling: GET/HEAD with body", "RequestSmuggling", "High", "Medium", 2, 7, "protocol,smuggling", r"(?i)^(GET|HEAD)\s.*content-length:\s*[1-9]"),
    (920111, "Request Smuggling: Duplicate headers", "RequestSmuggling", "Critical", "High", 1, 9, "protocol,smuggling", r"(?i)(content-length|transfer-encoding).*\r?\n.*(content-length|transfer-encoding)"),
    (920112, "Request Smuggling: CL.TE attack", "RequestSmuggling", "Critical", "High", 1, 10, "protocol,smuggling", r"(?i)content-length:.*transfer-encoding:|transfer-encoding:.*content-length:"),
    (920113, "Request Smuggling: Obfuscated Transfer-Encoding", "RequestSmuggling", "Critical", "High", 1, 10, "protocol,smuggling", r"(?i)transfer-encoding\s*:\s*(chunked\s*,|,\s*chunked|\s+chunked)"),
    (920120, "Protocol: HTTP method override", "ProtocolAttack", "Medium", "Medium", 2, 6, "protocol,method-override", r"(?i)(x-http-method-override|x-http-method|x-method-override)\s*:\s*(DELETE|PUT|PATCH)"),
    (920130, "Protocol: Invalid Host header", "ProtocolAttack", "Medium", "Low", 3, 4, "protocol,host-header", r"(?i)host\s*:\s*(localhost|127\.0\.0\.1|0\.0\.0\.0|::1)"),
    (920140, "Protocol: HTTP response splitting", "ProtocolAttack", "High", "High", 1, 8, "protocol,crlf,response-splitting", r"(%0d%0a|%0D%0A|\r\n)"),
)
