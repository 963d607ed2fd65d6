"""xss: detection rules."""

# These must equal the reference's for equal results.
# id, name, attack type, severity, confidence, paranoia level, base score, tags, pattern
RULES = (
    (941100, "XSS: Script tag detected", "Xss", "Critical", "High", 1, 9, "xss,xss-script", r"(?i)<script[^>]*>"),
    (941101, "XSS: Closing script tag", "Xss", "High", "High", 1, 8, "xss,xss-script", r"(?i)</script>"),
    (941102, "XSS: Script src attribute", "Xss", "Critical", "High", 1, 10, "xss,xss-script", r"""(?i)<script[^>]+src\s*=\s*["']?[^"'>\s]+"""),
    (941110, "XSS: Event handler onerror", "Xss", "High", "High", 1, 9, "xss,xss-event", r"(?i)\bonerror\s*="),
    (941111, "XSS: Event handler onload", "Xss", "High", "High", 1, 9, "xss,xss-event", r"(?i)\bonload\s*="),
    (941112, "XSS: Event handler onclick", "Xss", "High", "High", 1, 8, "xss,xss-event", r"(?i)\bonclick\s*="),
    (941113, "XSS: Event handler onmouseover", "Xss", "High", "High", 1, 8, "xss,xss-event", r"(?i)\bonmouseover\s*="),
    (941114, "XSS: Event handler onfocus onblur", "Xss", "High", "High", 1, 8, "xss,xss-event", r"(?i)\b(onfocus|onblur)\s*="),
    (941115, "XSS: Generic event handler", "Xss", "Medium", "Medium", 2, 6, "xss,xss-event", r"(?i)\bon[a-z]{3,15}\s*="),
    (941120, "XSS: javascript URI", "Xss", "Critical", "High", 1, 9, "xss,xss-uri", r"(?i)javascript\s*:"),
    (941121, "XSS: vbscript URI", "Xss", "Critical", "High", 1, 9, "xss,xss-uri", r"(?i)vbscript\s*:"),
    (941122, "XSS: data URI with HTML", "Xss", "High", "High", 1, 8, "xss,xss-uri", r"(?i)data\s*:\s*text/html"),
    (941123, "XSS: data URI base64", "Xss", "Medium", "Medium", 2, 6, "xss,xss-uri", r"(?i)data\s*:[^;]+;\s*base64"),
    (941130, "XSS: iframe tag", "Xss", "High", "High", 1, 8, "xss,xss-tag", r"(?i)<iframe"),
    (941131, "XSS: object embed tag", "Xss", "High", "High", 1, 8, "xss,xss-tag", r"(?i)<(object|embed|applet)"),
    (941132, "XSS: SVG tag", "Xss", "High", "Medium", 1, 7, "xss,xss-tag,xss-svg", r"(?i)<svg[^>]*>"),
    (941133, "XSS: math tag", "Xss", "Medium", "Medium", 2, 5, "xss,xss-tag", r"(?i)<math[^>]*>"),
    (941134, "XSS: img tag with onerror", "Xss", "Critical", "High", 1, 9, "xss,xss-tag,xss-event", r"(?i)<img[^>]+onerror\s*="),
    (941135, "XSS: body tag with onload", "Xss", "High", "High", 1, 8, "xss,xss-tag,xss-event", r"(?i)<body[^>]+onload\s*="),
    (941140, "XSS: CSS expression", "Xss", "High", "High", 1, 8, "xss,xss-css", r"(?i)expression\s*\("),
    (941141, "XSS: CSS behavior", "Xss", "High", "High", 1, 8, "xss,xss-css", r"(?i)behavior\s*:"),
    (941142, "XSS: CSS moz-binding", "Xss", "High", "High", 1, 8, "xss,xss-css", r"(?i)-moz-binding\s*:"),
    (941143, "XSS: style tag", "Xss", "Medium", "Medium", 2, 5, "xss,xss-css", r"(?i)<style[^>]*>"),
    (941150, "XSS: document.write", "Xss", "High", "Medium", 2, 7, "xss,xss-dom", r"(?i)document\s*[.]\s*write(ln)?\s*\("),
    (941151, "XSS: innerHTML", "Xss", "High", "Medium", 2, 7, "xss,xss-dom", r"(?i)[.]innerHTML\s*="),
    (941152, "XSS: eval function", "Xss", "Critical", "High", 1, 9, "xss,xss-dom,rce", r"(?i)\beval\s*\("),
    (941153, "XSS: setTimeout setInterval with string", "Xss", "High", "Medium", 2, 7, "xss,xss-dom", r"""(?i)(setTimeout|setInterval)\s*\(\s*['"]"""),
    (941154, "XSS: Function constructor", "Xss", "Critical", "High", 1, 9, "xss,xss-dom,rce", r"(?i)new\s+Function\s*\("),
    (941160, "XSS: Polyglot jaVasCript", "Xss", "High", "High", 2, 8, "xss,xss-evasion", r"(jaVasCript|JaVaScRiPt|jAvAsCrIpT)"),
    (941161, "XSS: HTML entity encoding", "Xss", "Medium", "Medium", 2, 6, "xss,xss-encoded", r"(?i)(&lt;|&#60;|&#x3c;)\s*script"),
    (941162, "XSS: Unicode encoding", "Xss", "Medium", "Medium", 2, 6, "xss,xss-encoded", r"(\\u003c|\\x3c|%3c)"),
    (941170, "XSS: alert function", "Xss", "Medium", "Medium", 2, 5, "xss,xss-test", r"(?i)\balert\s*\("),
    (941171, "XSS: confirm prompt function", "Xss", "Medium", "Medium", 2, 5, "xss,xss-test", r"(?i)\b(confirm|prompt)\s*\("),
    (941180, "XSS: Null byte obfuscation", "Xss", "Medium", "Low", 3, 5, "xss,xss-evasion,pl3", r"(?i)(scr\x00ipt|java\x00script|on\x00error)"),
    (941181, "XSS: Tab/newline obfuscation", "Xss", "Medium", "Low", 3, 5, "xss,xss-evasion,pl3", r"(?i)<[\t\n\r]*script"),
    (941182, "XSS: Backtick template literals", "Xss", "Medium", "Low", 3, 4, "xss,xss-dom,pl3", r"`[^`]*\$\{[^}]+\}[^`]*`"),
    (941183, "XSS: Constructor property access", "Xss", "Medium", "Low", 3, 5, "xss,xss-dom,pl3", r"(?i)constructor\s*[\[(]"),
    (941184, "XSS: Proto pollution", "Xss", "Medium", "Low", 3, 5, "xss,xss-dom,pl3", r"(?i)(__proto__|prototype\s*\[)"),
    (941185, "XSS: atob/btoa functions", "Xss", "Low", "Low", 3, 3, "xss,xss-evasion,pl3", r"(?i)\b(atob|btoa)\s*\("),
    (941186, "XSS: fromCharCode", "Xss", "Medium", "Low", 3, 4, "xss,xss-evasion,pl3", r"(?i)fromCharCode\s*\("),
    (941187, "XSS: Less common event handlers", "Xss", "Medium", "Low", 3, 4, "xss,xss-event,pl3", r"(?i)\b(onanimation|ontransition|onpointer|onwheel|ondrag|onscroll)\w*\s*="),
    (941188, "XSS: SVG animate/set elements", "Xss", "Medium", "Low", 3, 5, "xss,xss-svg,pl3", r"(?i)<(animate|set|use)[^>]+(href|xlink)"),
    (941189, "XSS: Document/window/location access", "Xss", "Low", "Low", 3, 3, "xss,xss-dom,pl3", r"(?i)(document|window|location)\s*\["),
    (941190, "XSS: Any angle bracket", "Xss", "Low", "Low", 4, 2, "xss,xss-generic,pl4", r"<[a-zA-Z]"),
    (941191, "XSS: Closing angle bracket after equals", "Xss", "Low", "Low", 4, 2, "xss,xss-generic,pl4", r"""=\s*["']?[^"'>\s]*>"""),
    (941192, "XSS: Script-like word", "Xss", "Low", "Low", 4, 2, "xss,xss-generic,pl4", r"(?i)(script|javascript|vbscript|expression)"),
    (941193, "XSS: Parentheses after word", "Xss", "Low", "Low", 4, 1, "xss,xss-generic,pl4", r"[a-zA-Z_]\w*\s*\("),
    (941194, "XSS: Encoded angle bracket", "Xss", "Low", "Low", 4, 2, "xss,xss-encoded,pl4", r"(%3c|%3e|&lt|&gt|&#60|&#62|&#x3c|&#x3e)"),
    (941195, "XSS: On-prefix word", "Xss", "Low", "Low", 4, 2, "xss,xss-event,pl4", r"(?i)\bon[a-z]+\s*="),
    (941196, "XSS: Colon after protocol-like word", "Xss", "Low", "Low", 4, 2, "xss,xss-uri,pl4", r"(?i)(java|vb|live)script\s*:"),
    (941197, "XSS: Quote followed by event", "Xss", "Low", "Low", 4, 2, "xss,xss-evasion,pl4", r"""["']\s*\bon"""),
    (941198, "XSS: Ampersand hash sequence", "Xss", "Low", "Low", 4, 1, "xss,xss-encoded,pl4", r"&#\d+;"),
    (941199, "XSS: SVG/Math namespace", "Xss", "Low", "Low", 4, 1, "xss,xss-tag,pl4", r"(?i)(svg|math)"),
)
