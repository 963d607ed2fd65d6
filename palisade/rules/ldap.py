"""ldap: detection rules."""

# These must equal the reference's for equal results.
# id, name, attack type, severity, confidence, paranoia level, base score, tags, pattern
RULES = (
    (933100, "LDAP Injection: Filter injection", "LdapInjection", "High", "High", 1, 8, "ldap,injection", r"(?i)(\(|\)|\\28|\\29|\*|\x00|\\00)"),
    (933101, "LDAP Injection: Wildcard bypass", "LdapInjection", "Critical", "High", 1, 9, "ldap,auth-bypass", r"\*\)\(&|\)\(\|\("),
    (933102, "LDAP Injection: Boolean injection", "LdapInjection", "High", "High", 1, 7, "ldap,boolean", r"(?i)\(\||\(&|\(!"),
    (933103, "LDAP Injection: DN injection", "LdapInjection", "High", "Medium", 2, 6, "ldap,dn", r"(?i)(cn|uid|dc|ou|objectclass)\s*="),
    (933104, "LDAP Injection: Null byte", "LdapInjection", "High", "High", 1, 8, "ldap,null-byte", r"(%00|\\00|\x00)"),
)
