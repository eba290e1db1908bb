"""Pattern data of the detectors. The results depend on each pattern, score and their order."""

KEYWORDS = {
    "sql_injection": [
        (r"\bunion\s+(all\s+)?select\b", 90), (r"\bselect\s+.*\bfrom\s+", 85), (r"\bdrop\s+(table|database)\b", 95),
        (r"\binsert\s+into\b", 80), (r"\bupdate\s+.*\bset\b", 80), (r"\bdelete\s+from\b", 85), (r"\bexec\s*\(", 90),
        (r"sqlmap", 95), (r"(\bor\b|\band\b)\s+\d+\s*=\s*\d+", 80),
    ],
    "command_execution": [
        (r"\bcmd\s*/c\b", 90), (r"\bpowershell\b", 85), (r"\bbash\s+-c\b", 90), (r"\bwget\s+", 85), (r"\bcurl\s+", 85),
        (r"\bnc\s+-", 90), (r"\bnetcat\s+", 90),
    ],
    "xss": [
        (r"<script[^>]*>", 90), (r"javascript:\s*", 85), (r"\balert\s*\(", 85), (r"\beval\s*\(", 90),
        (r"""on\w+\s*=\s*['"][^'"]*['"]""", 80),
    ],
}
SCANNING = [
    (r"\.\.\/", 70), (r"\.\.\\", 70), (r"\/\.\.\/%", 75), (r"\/admin\/?$", 60), (r"\/backup\/?$", 65), (r"\/config\/?$", 65),
    (r"\/wp-admin\/?", 60), (r"\/phpmyadmin\/?", 65), (r"\/manager\/?", 60), (r"\/login\/?$", 50), (r"\/test\/?$", 55),
    (r"\/tmp\/?$", 60), (r"\/uploads?\/?", 55), (r"\.php\?", 55), (r"\.asp\?", 55), (r"\.jsp\?", 55), (r"\.cgi\?", 60),
    (r"\.sh$", 65), (r"\.sql$", 70), (r"\.bak$", 65), (r"\.old$", 65), (r"nikto", 80), (r"dirb", 75), (r"dirbuster", 75),
    (r"gobuster", 75), (r"sqlmap", 85), (r"nmap", 80), (r"masscan", 80),
]
ABUSE_CATEGORIES = {
    1: "DNS Compromise", 2: "DNS Poisoning", 3: "Fraud Orders", 4: "DDoS Attack", 5: "FTP Brute-Force", 6: "Ping of Death",
    7: "Phishing", 8: "Fraud VoIP", 9: "Open Proxy", 10: "Web Spam", 11: "Email Spam", 12: "Blog Spam", 13: "VPN IP",
    14: "Port Scan", 15: "Hacking", 16: "SQL Injection", 17: "Spoofing", 18: "Brute-Force", 19: "Bad Web Bot",
    20: "Exploited Host", 21: "Web App Attack", 22: "SSH", 23: "IoT Targeted",
}
#: IPv4 ranges that are not public, and the addresses in them that are.
NOT_PUBLIC = ["0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.0.170/31", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4", "255.255.255.255/32"]
PUBLIC_ANYWAY = ["192.0.0.9", "192.0.0.10"]
# Special IPv6 networks of the public registry. Those of the second list are public within the first.
NOT_PUBLIC_6 = ["::/8", "64:ff9b:1::/48", "100::/8", "200::/7", "400::/6", "800::/5", "1000::/4", "2001::/23", "2001:db8::/32", "2002::/16", "4000::/3", "6000::/3", "8000::/3", "a000::/3", "c000::/3", "e000::/4", "f000::/5", "f800::/6", "fc00::/7", "fe00::/9", "fe80::/10"]
PUBLIC_WITHIN_6 = ["2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28"]
