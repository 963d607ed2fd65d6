"""scanner: detection rules."""

# These must equal the reference's for equal results.
# id, name, attack type, severity, confidence, paranoia level, base score, tags, pattern
RULES = (
    (913100, "Scanner: SQLMap detected", "ScannerDetection", "High", "High", 1, 8, "scanner,sqli-scanner", r"(?i)(sqlmap|havij|pangolin)"),
    (913101, "Scanner: Nikto detected", "ScannerDetection", "High", "High", 1, 8, "scanner,web-scanner", r"(?i)(nikto|wikto)"),
    (913102, "Scanner: Nessus detected", "ScannerDetection", "High", "High", 1, 8, "scanner,vuln-scanner", r"(?i)(nessus|openvas)"),
    (913103, "Scanner: Acunetix detected", "ScannerDetection", "High", "High", 1, 8, "scanner,web-scanner", r"(?i)(acunetix|acunetix-wvs)"),
    (913104, "Scanner: Burp Suite detected", "ScannerDetection", "Medium", "High", 1, 6, "scanner,proxy", r"(?i)(burp|portswigger)"),
    (913110, "Scanner: Nmap detected", "ScannerDetection", "Medium", "High", 1, 6, "scanner,network-scanner", r"(?i)(nmap|masscan|zmap)"),
    (913120, "Scanner: DirBuster/Gobuster detected", "ScannerDetection", "High", "High", 1, 7, "scanner,directory-bruteforce", r"(?i)(dirbuster|gobuster|dirb|feroxbuster|ffuf)"),
    (913130, "Scanner: WPScan detected", "ScannerDetection", "High", "High", 1, 7, "scanner,cms-scanner", r"(?i)(wpscan|droopescan|joomscan)"),
    (913140, "Scanner: Metasploit detected", "ScannerDetection", "Critical", "High", 1, 10, "scanner,exploitation", r"(?i)(metasploit|meterpreter)"),
    (913150, "Scanner: Bad bot User-Agent", "ScannerDetection", "Medium", "Medium", 2, 4, "scanner,bot", r"(?i)(python-requests|wget|curl|httpclient|java/)"),
    (913151, "Scanner: Empty/missing User-Agent", "ScannerDetection", "Low", "Low", 3, 2, "scanner,bot", r"^-$|^$"),
    (913160, "Scanner: Hydra detected", "ScannerDetection", "Critical", "High", 1, 10, "scanner,bruteforce", r"(?i)(hydra|medusa|patator)"),
)
