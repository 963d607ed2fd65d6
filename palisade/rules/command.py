"""command: detection rules."""

# These must equal the reference's for equal results.
# id, name, attack type, severity, confidence, paranoia level, base score, tags, pattern
RULES = (
    (932100, "Command Injection: Pipe operator", "CommandInjection", "Critical", "High", 1, 10, "cmdi,unix", r"(?i)\|\s*(cat|ls|id|whoami|pwd|uname|curl|wget|nc|bash|sh|python|perl|ruby|php)\b"),
    (932101, "Command Injection: Semicolon chaining", "CommandInjection", "Critical", "High", 1, 10, "cmdi,unix", r"(?i);\s*(cat|ls|id|whoami|pwd|uname|curl|wget|nc|bash|sh)\b"),
    (932102, "Command Injection: Backtick execution", "CommandInjection", "Critical", "High", 1, 9, "cmdi,unix", r"`[^`]+`"),
    (932103, "Command Injection: $() substitution", "CommandInjection", "Critical", "High", 1, 9, "cmdi,unix", r"\$\([^)]+\)"),
    (932104, "Command Injection: && chaining", "CommandInjection", "Critical", "High", 1, 10, "cmdi,unix", r"(?i)&&\s*(cat|ls|id|whoami|curl|wget|nc|bash|sh|rm|chmod|chown)\b"),
    (932105, "Command Injection: || chaining", "CommandInjection", "High", "High", 1, 9, "cmdi,unix", r"(?i)\|\|\s*(cat|ls|id|whoami|curl|wget|nc|bash|sh)\b"),
    (932106, "Command Injection: /bin path", "CommandInjection", "Critical", "High", 1, 10, "cmdi,unix", r"(?i)/(bin|usr/bin|sbin)/(sh|bash|dash|zsh|csh|ksh|python|perl|ruby|php)"),
    (932107, "Command Injection: Reverse shell", "CommandInjection", "Critical", "High", 1, 10, "cmdi,reverse-shell", r"(?i)(nc|ncat|netcat)\s+(-e|--exec|-c)\s+"),
    (932108, "Command Injection: Bash reverse shell", "CommandInjection", "Critical", "High", 1, 10, "cmdi,reverse-shell", r"(?i)bash\s+-i\s+>&\s*/dev/tcp/"),
    (932120, "Command Injection: cmd.exe", "CommandInjection", "Critical", "High", 1, 10, "cmdi,windows", r"(?i)cmd(\.exe)?\s*/c\s+"),
    (932121, "Command Injection: PowerShell", "CommandInjection", "Critical", "High", 1, 10, "cmdi,windows,powershell", r"(?i)powershell(\.exe)?\s+(-e\s+|-enc\s+|-command\s+|-nop\s+)"),
    (932122, "Command Injection: PowerShell encoded", "CommandInjection", "Critical", "High", 1, 10, "cmdi,windows,powershell", r"(?i)powershell.*-encodedcommand\s+"),
    (932123, "Command Injection: Windows net command", "CommandInjection", "High", "High", 1, 8, "cmdi,windows", r"(?i)\bnet\s+(user|localgroup|group|share|view)\b"),
    (932124, "Command Injection: Windows wmic", "CommandInjection", "High", "High", 1, 8, "cmdi,windows", r"(?i)\bwmic\s+(process|os|computersystem|useraccount)"),
    (932130, "Command Injection: Environment variable", "CommandInjection", "Medium", "Medium", 2, 5, "cmdi,env", r"(?i)\$\{[A-Z_][A-Z0-9_]*\}"),
    (932131, "Command Injection: IFS manipulation", "CommandInjection", "High", "High", 2, 8, "cmdi,unix,env", r"(?i)IFS\s*="),
    (932140, "Command Injection: rm -rf", "CommandInjection", "Critical", "High", 1, 10, "cmdi,unix,destructive", r"(?i)\brm\s+(-rf|-fr|--recursive)"),
    (932141, "Command Injection: chmod 777", "CommandInjection", "High", "High", 1, 8, "cmdi,unix", r"(?i)\bchmod\s+[0-7]?777\b"),
    (932150, "Command Injection: Newline separator", "CommandInjection", "Medium", "Low", 3, 5, "cmdi,cmdi-evasion,pl3", r"[\r\n]+(cat|ls|id|whoami|curl|wget|bash|sh|python|perl)\b"),
    (932151, "Command Injection: Null byte separator", "CommandInjection", "Medium", "Low", 3, 5, "cmdi,cmdi-evasion,pl3", r"\x00.*(cat|ls|id|whoami|bash|sh)"),
    (932152, "Command Injection: Variable concatenation", "CommandInjection", "Medium", "Low", 3, 4, "cmdi,cmdi-evasion,pl3", r"""(?i)(\$[a-z]'[^']*'|\$[a-z]"[^"]*"|[a-z]\$[a-z])"""),
    (932153, "Command Injection: Hex/octal encoding", "CommandInjection", "Medium", "Low", 3, 5, "cmdi,cmdi-evasion,pl3", r"(?i)(\$'\\x[0-9a-f]{2}|\\[0-7]{3})"),
    (932154, "Command Injection: Brace expansion", "CommandInjection", "Medium", "Low", 3, 4, "cmdi,cmdi-evasion,pl3", r"\{[a-z]+,[a-z]+\}"),
    (932155, "Command Injection: $IFS space bypass", "CommandInjection", "Medium", "Low", 3, 5, "cmdi,cmdi-evasion,pl3", r"(?i)\$IFS"),
    (932156, "Command Injection: Tab/space bypass", "CommandInjection", "Medium", "Low", 3, 4, "cmdi,cmdi-evasion,pl3", r"[\t]+(cat|ls|id|whoami|curl|wget|bash|sh)\b"),
    (932157, "Command Injection: Glob wildcard", "CommandInjection", "Low", "Low", 3, 4, "cmdi,cmdi-evasion,pl3", r"/\?\?\?/[a-z]"),
    (932158, "Command Injection: Command substitution in string", "CommandInjection", "Medium", "Low", 3, 5, "cmdi,cmdi-evasion,pl3", r'"[^"]*\$\([^)]+\)[^"]*"'),
    (932159, "Command Injection: Encoded pipe/semicolon", "CommandInjection", "Medium", "Low", 3, 4, "cmdi,cmdi-evasion,pl3", r"(?i)(%7c|%3b|%26|%0a|%0d)"),
    (932170, "Command Injection: Any pipe character", "CommandInjection", "Low", "Low", 4, 2, "cmdi,cmdi-generic,pl4", r"\|"),
    (932171, "Command Injection: Any semicolon", "CommandInjection", "Low", "Low", 4, 2, "cmdi,cmdi-generic,pl4", r";"),
    (932172, "Command Injection: Any backtick", "CommandInjection", "Low", "Low", 4, 2, "cmdi,cmdi-generic,pl4", r"`"),
    (932173, "Command Injection: Any dollar sign", "CommandInjection", "Low", "Low", 4, 2, "cmdi,cmdi-generic,pl4", r"\$"),
    (932174, "Command Injection: Any ampersand", "CommandInjection", "Low", "Low", 4, 2, "cmdi,cmdi-generic,pl4", r"&"),
    (932175, "Command Injection: Any redirect", "CommandInjection", "Low", "Low", 4, 2, "cmdi,cmdi-generic,pl4", r"[<>]"),
    (932176, "Command Injection: Unix command names", "CommandInjection", "Low", "Low", 4, 2, "cmdi,cmdi-generic,pl4", r"(?i)\b(cat|ls|id|whoami|pwd|uname|echo|printf|read|eval|exec)\b"),
    (932177, "Command Injection: Network commands", "CommandInjection", "Low", "Low", 4, 2, "cmdi,cmdi-generic,pl4", r"(?i)\b(curl|wget|nc|netcat|telnet|ftp|ssh|scp|rsync)\b"),
    (932178, "Command Injection: Scripting interpreters", "CommandInjection", "Low", "Low", 4, 2, "cmdi,cmdi-generic,pl4", r"(?i)\b(bash|sh|zsh|ksh|csh|python|perl|ruby|php|node)\b"),
    (932179, "Command Injection: Filesystem commands", "CommandInjection", "Low", "Low", 4, 2, "cmdi,cmdi-generic,pl4", r"(?i)\b(rm|mv|cp|mkdir|rmdir|touch|chmod|chown|ln)\b"),
)
