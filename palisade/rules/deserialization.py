"""deserialization: detection rules."""

# These must equal the reference's for equal results.
# id, name, attack type, severity, confidence, paranoia level, base score, tags, pattern
RULES = (
    (937100, "Deserialization: Java serialized object", "Deserialization", "Critical", "High", 1, 10, "deserialization,java", r"(?i)(rO0AB|aced0005)"),
    (937101, "Deserialization: Java Commons Collections", "Deserialization", "Critical", "High", 1, 10, "deserialization,java,gadget", r"(?i)(org\.apache\.commons\.collections\.(functors|map)|InvokerTransformer|ConstantTransformer)"),
    (937102, "Deserialization: Java Spring gadgets", "Deserialization", "Critical", "High", 1, 10, "deserialization,java,spring", r"(?i)(org\.springframework\.(beans|aop)|MethodInvoker|PropertyPathFactoryBean)"),
    (937103, "Deserialization: Java JNDI injection", "Deserialization", "Critical", "High", 1, 10, "deserialization,java,log4shell,jndi", r"(?i)\$\{(jndi|env|sys|java|lower|upper|date):.*\}"),
    (937104, "Deserialization: Java OGNL", "Deserialization", "Critical", "High", 1, 10, "deserialization,java,ognl", r"(?i)(\#|@)ognl|%\{.*\}|#context\["),
    (937110, "Deserialization: PHP object serialization", "Deserialization", "Critical", "High", 1, 9, "deserialization,php", r"(?i)(O:\d+:|a:\d+:\{|s:\d+:)"),
    (937111, "Deserialization: PHP __wakeup/__destruct", "Deserialization", "Critical", "High", 1, 9, "deserialization,php,magic-method", r"(?i)(__wakeup|__destruct|__toString|__call)"),
    (937112, "Deserialization: PHP POP chain", "Deserialization", "Critical", "High", 1, 9, "deserialization,php,gadget", r"(?i)(Monolog\\Handler|Guzzle\\Psr7|Symfony\\Component)"),
    (937120, "Deserialization: Python pickle", "Deserialization", "Critical", "High", 1, 10, "deserialization,python,pickle", r"(?i)(c__builtin__|cposix|cos\nsystem|creduce)"),
    (937121, "Deserialization: Python PyYAML", "Deserialization", "Critical", "High", 1, 10, "deserialization,python,yaml", r"(?i)(!!python/object|!!python/module|yaml\.unsafe_load)"),
    (937130, "Deserialization: .NET BinaryFormatter", "Deserialization", "Critical", "High", 1, 10, "deserialization,dotnet", r"(?i)(BinaryFormatter|SoapFormatter|LosFormatter|ObjectStateFormatter)"),
    (937131, "Deserialization: .NET TypeNameHandling", "Deserialization", "Critical", "High", 1, 10, "deserialization,dotnet,json", r'(?i)"\$type"\s*:\s*"(System\.Web|System\.Windows|Microsoft\.)'),
    (937132, "Deserialization: .NET ViewState", "Deserialization", "High", "Medium", 2, 6, "deserialization,dotnet,viewstate", r"(?i)(__VIEWSTATE|__EVENTVALIDATION|__VIEWSTATEGENERATOR)"),
    (937140, "Deserialization: Ruby Marshal", "Deserialization", "Critical", "High", 1, 10, "deserialization,ruby", r"(?i)(\x04\x08o:|Marshal\.load|YAML\.load)"),
    (937141, "Deserialization: Ruby ERB injection", "Deserialization", "Critical", "High", 1, 10, "deserialization,ruby,erb", r"<%=?\s*(system|exec|`|IO\.)"),
)
