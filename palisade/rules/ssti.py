"""ssti: detection rules."""

# These must equal the reference's for equal results.
# id, name, attack type, severity, confidence, paranoia level, base score, tags, pattern
RULES = (
    (935100, "SSTI: Template expression {{", "Ssti", "High", "Medium", 1, 7, "ssti,template", r"\{\{.*\}\}"),
    (935101, "SSTI: Template expression ${", "Ssti", "High", "Medium", 1, 7, "ssti,template", r"\$\{.*\}"),
    (935102, "SSTI: Template expression <%", "Ssti", "High", "Medium", 1, 7, "ssti,template", r"<%.*%>"),
    (935110, "SSTI: Jinja2 config access", "Ssti", "Critical", "High", 1, 9, "ssti,jinja2,python", r"(?i)\{\{\s*config\s*\}\}|\{\{\s*request\."),
    (935111, "SSTI: Jinja2 class access", "Ssti", "Critical", "High", 1, 10, "ssti,jinja2,python,rce", r"(?i)__class__|__mro__|__subclasses__|__globals__|__builtins__"),
    (935112, "SSTI: Jinja2 popen/system", "Ssti", "Critical", "High", 1, 10, "ssti,jinja2,python,rce", r"(?i)(popen|system|subprocess|os\.)"),
    (935120, "SSTI: Twig filter", "Ssti", "High", "Medium", 2, 6, "ssti,twig,php", r"\{\{\s*[^}]+\|"),
    (935121, "SSTI: Twig _self access", "Ssti", "Critical", "High", 1, 10, "ssti,twig,php,rce", r"(?i)_self\.env\.registerUndefinedFilterCallback"),
    (935130, "SSTI: Freemarker built-ins", "Ssti", "Critical", "High", 1, 9, "ssti,freemarker,java", r"(?i)\?\s*(new|api|exec|eval)"),
    (935131, "SSTI: Freemarker Execute", "Ssti", "Critical", "High", 1, 10, "ssti,freemarker,java,rce", r"(?i)freemarker\.template\.utility\.Execute"),
    (935140, "SSTI: Velocity class loading", "Ssti", "Critical", "High", 1, 9, "ssti,velocity,java", r"(?i)\$class\.inspect|\.getClass\(\)"),
    (935141, "SSTI: Velocity Runtime", "Ssti", "Critical", "High", 1, 10, "ssti,velocity,java,rce", r"(?i)\$\w+\.class\.forName|java\.lang\.Runtime"),
    (935150, "SSTI: Smarty php tag", "Ssti", "Critical", "High", 1, 10, "ssti,smarty,php,rce", r"(?i)\{php\}|\{/php\}"),
    (935160, "SSTI: Handlebars helper injection", "Ssti", "High", "Medium", 2, 6, "ssti,handlebars,javascript", r"\{\{#with\s+|\{\{#each\s+"),
    (935170, "SSTI: ERB code execution", "Ssti", "Critical", "High", 1, 10, "ssti,erb,ruby,rce", r"<%=?\s*(system|exec|`|eval|IO\.)"),
    (935180, "SSTI: Unicode brackets", "Ssti", "Medium", "Low", 3, 5, "ssti,ssti-evasion,pl3", r"(?i)(\uFF5B|\u007B\u007B|\uFE5B)"),
    (935181, "SSTI: String concatenation bypass", "Ssti", "Medium", "Low", 3, 5, "ssti,ssti-evasion,pl3", r"""\{\{['"][^'"]+['"]\s*\+\s*['"]"""),
    (935182, "SSTI: Bracket attribute access", "Ssti", "Medium", "Low", 3, 6, "ssti,ssti-evasion,pl3", r"\['__(class|mro|globals|subclasses)__'\]"),
    (935183, "SSTI: getattr/attr function", "Ssti", "Medium", "Low", 3, 5, "ssti,ssti-evasion,pl3", r"(?i)(getattr|attr)\s*\("),
    (935184, "SSTI: Encoded class attribute", "Ssti", "Medium", "Low", 3, 5, "ssti,ssti-evasion,pl3", r"(?i)(%5f%5f|%5F%5F)(class|mro|globals)"),
    (935185, "SSTI: Lipsum/cycler exploit", "Ssti", "Medium", "Low", 3, 5, "ssti,jinja2,ssti-evasion,pl3", r"(?i)(lipsum|cycler|joiner|namespace)\s*\."),
    (935186, "SSTI: Request object abuse", "Ssti", "Medium", "Low", 3, 5, "ssti,jinja2,ssti-evasion,pl3", r"(?i)request\s*\.\s*(application|args|cookies|data|environ)"),
    (935187, "SSTI: Hex/octal string bypass", "Ssti", "Medium", "Low", 3, 5, "ssti,ssti-evasion,pl3", r"\{\{[^}]*(\\x[0-9a-f]{2}|\\[0-7]{3})"),
    (935188, "SSTI: Filter chain", "Ssti", "Medium", "Low", 3, 4, "ssti,ssti-evasion,pl3", r"\{\{[^}]+\|[^}]+\|[^}]+\}\}"),
    (935189, "SSTI: Set/import statements", "Ssti", "Medium", "Low", 3, 5, "ssti,ssti-evasion,pl3", r"(?i)\{%\s*(set|import|from|include)\s+"),
    (935190, "SSTI: Any double brace", "Ssti", "Low", "Low", 4, 2, "ssti,ssti-generic,pl4", r"\{\{|\}\}"),
    (935191, "SSTI: Any angle percent", "Ssti", "Low", "Low", 4, 2, "ssti,ssti-generic,pl4", r"<%|%>"),
    (935192, "SSTI: Dollar brace", "Ssti", "Low", "Low", 4, 2, "ssti,ssti-generic,pl4", r"\$\{"),
    (935193, "SSTI: Dunder pattern", "Ssti", "Low", "Low", 4, 2, "ssti,ssti-generic,pl4", r"__[a-zA-Z]+__"),
    (935194, "SSTI: Dot bracket access", "Ssti", "Low", "Low", 4, 2, "ssti,ssti-generic,pl4", r"""\[['"][a-zA-Z_]+['"]\]"""),
    (935195, "SSTI: Pipe filter", "Ssti", "Low", "Low", 4, 2, "ssti,ssti-generic,pl4", r"\{\{[^}]*\|"),
    (935196, "SSTI: Hash/block syntax", "Ssti", "Low", "Low", 4, 2, "ssti,ssti-generic,pl4", r"\{\{#"),
    (935197, "SSTI: Class-like words", "Ssti", "Low", "Low", 4, 2, "ssti,ssti-generic,pl4", r"(?i)\b(class|mro|subclasses|globals|builtins|init)\b"),
    (935198, "SSTI: Template keywords", "Ssti", "Low", "Low", 4, 2, "ssti,ssti-generic,pl4", r"(?i)\b(config|request|self|env|template)\b"),
    (935199, "SSTI: Runtime/exec words", "Ssti", "Low", "Low", 4, 2, "ssti,ssti-generic,pl4", r"(?i)\b(runtime|popen|system|exec|eval|import)\b"),
)
