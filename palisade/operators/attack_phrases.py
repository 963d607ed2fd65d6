"""Phrases of four kinds of attack, that the n-gram classifier weighs its n-grams by."""

# These must equal the reference's for equal scores.
PHRASES = {
    "SqlInjection": (
        'select',
        'union',
        'insert',
        'update',
        'delete',
        'drop',
        'truncate',
        'from',
        'where',
        'and',
        'or',
        'having',
        'group by',
        'order by',
        "' or '",
        "' and '",
        '1=1',
        "1'='1",
        "' --",
        "'; --",
        '/**/',
        "' or 1=1",
        "admin'--",
        "' union select",
        'concat(',
        'char(',
        'ascii(',
        'substring(',
        'length(',
        'benchmark(',
        'sleep(',
        'waitfor',
        'pg_sleep',
        'dbms_pipe',
        'extractvalue(',
        'updatexml(',
        'exp(~',
        'information_schema',
        'sys.tables',
        'sqlite_master',
        '@@version',
        'version()',
        'database()',
        'user()',
    ),
    "Xss": (
        '<script',
        '</script>',
        'javascript:',
        'vbscript:',
        'onerror=',
        'onload=',
        'onclick=',
        'onmouseover=',
        'onfocus=',
        'onblur=',
        'onchange=',
        'onsubmit=',
        'onkeypress=',
        'onkeyup=',
        'alert(',
        'prompt(',
        'confirm(',
        'eval(',
        'document.',
        'window.',
        '.cookie',
        'innerhtml',
        'outerhtml',
        '&#x',
        '&#',
        '\\x',
        '\\u00',
        '<svg',
        '<math',
        '<img src=x',
        '<body onload',
        'data:text/html',
        'data:application/',
    ),
    "CommandInjection": (
        '; ',
        '| ',
        '|| ',
        '&& ',
        '` ',
        '$(',
        '/bin/sh',
        '/bin/bash',
        'cmd.exe',
        'powershell',
        'cat /etc',
        'type ',
        'dir ',
        'ls ',
        'whoami',
        'id ',
        'wget ',
        'curl ',
        'nc ',
        'ncat',
        'netcat',
        'bash -i',
        '/dev/tcp',
        'mkfifo',
        'telnet ',
        '$path',
        '$home',
        '%systemroot%',
        '%comspec%',
    ),
    "PathTraversal": (
        '../',
        '..\\',
        '....//',
        '....\\\\',
        '%2e%2e',
        '%252e',
        '..%c0%af',
        '..%255c',
        '%00',
        '\x00',
        '/etc/passwd',
        '/etc/shadow',
        'win.ini',
        'boot.ini',
        '/proc/self',
        '/var/log',
        'file://',
        'php://',
        'zip://',
        'data://',
    ),
}
