"""Reference data: every constant that decides a result.

All tables here are fixed values. Operators take them as default arguments, so a
caller can pass other rules, chains, ports or technique tables.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    name: str
    pattern: str
    severity: str
    enabled: bool = True


class Technique(NamedTuple):
    tactic: str
    tactic_id: str
    technique: str
    technique_id: str
    subtechnique_id: str = ""


class Chain(NamedTuple):
    name: str
    tactics: tuple[str, ...]
    window_minutes: int
    severity: str
    description: str
    cooldown_minutes: int = 30


# --- fixed values: severities -------------------------------------------------
LEVEL_RANK = {"DEBUG": 0, "INFO": 1, "WARNING": 2, "ERROR": 3, "CRITICAL": 4}
RULE_SEVERITY_RANK = {"info": 0, "warning": 1, "critical": 2}
RULE_SEVERITY_LEVEL = {"info": "INFO", "warning": "WARNING", "critical": "CRITICAL"}

# Words that set the level of a plain text line; the first group that hits wins.
LEVEL_WORDS = [
    ("CRITICAL", ["crit", "critical", "fatal", "emerg", "alert", "panic"]),
    ("ERROR", ["err", "error"]),
    ("WARNING", ["warn", "warning"]),
    ("DEBUG", ["debug"]),
]

# --- fixed values: detection rules (name, case-insensitive regex, severity) ----
RULES = [
    Rule("SSH Brute Force", r"Failed password.*ssh|sshd.*Invalid user", "critical"),
    Rule("Sudo Escalation", r"sudo.*COMMAND|sudo.*authentication failure", "warning"),
    Rule("Failed Login", r"authentication failure|Failed password|Invalid user|pam_unix.*failed", "warning"),
    Rule("Root Login", r"session opened for user root|ROOT LOGIN|logged in as root", "critical"),
    Rule("Process Crash", r"segfault|core dump(ed)?|killed process|signal 11", "warning"),
    Rule("Firewall Block", r"IPTABLES.*DROP|UFW BLOCK|firewall.*DENY|Blocked.*port", "warning"),
    Rule("Malware Indicator", r"wget https?://|curl https?://|base64 -d|/tmp/\w+\.(sh|py|pl|elf)", "critical"),
    Rule("Log Tampering", r"rm.*\.log|truncate.*log|> /var/log|shred.*log", "critical"),
    Rule("Port Scan", r"nmap|masscan|port scan|SYN flood|too many connections", "critical"),
    Rule("Kernel Error", r"kernel:.*(?:ERROR|FATAL|BUG|panic|Oops)", "warning"),
    Rule("OOM Killer", r"Out of memory.*Kill process|oom.kill", "warning"),
    Rule("USB Device", r"(?:usb|USB).*(?:attached|connected|new (?:full|high|low|super))", "warning"),
    Rule("Suspicious Cron", r"crontab.*(?:root|nobody)|CRON.*(?:wget|curl|bash|python)", "critical"),
    Rule("Reverse Shell Indicator", r"(?:bash|sh|nc|ncat|netcat).*-[ei]|/dev/tcp/|mkfifo", "critical"),
    Rule("Privilege File Modified", r"(?:chmod|chown).*(?:/etc/passwd|/etc/shadow|/etc/sudoers)", "critical"),
]

# --- fixed values: ATT&CK tactics in kill-chain order --------------------------
TACTICS = [
    ("TA0043", "Reconnaissance"),
    ("TA0042", "Resource Development"),
    ("TA0001", "Initial Access"),
    ("TA0002", "Execution"),
    ("TA0003", "Persistence"),
    ("TA0004", "Privilege Escalation"),
    ("TA0005", "Defense Evasion"),
    ("TA0006", "Credential Access"),
    ("TA0007", "Discovery"),
    ("TA0008", "Lateral Movement"),
    ("TA0009", "Collection"),
    ("TA0011", "Command and Control"),
    ("TA0010", "Exfiltration"),
    ("TA0040", "Impact"),
]
TACTIC_ID = {name: tactic_id for tactic_id, name in TACTICS}


def _t(tactic: str, technique: str, technique_id: str, subtechnique_id: str = "") -> Technique:
    return Technique(tactic, TACTIC_ID[tactic], technique, technique_id, subtechnique_id)


# --- fixed values: rule name -> technique --------------------------------------
RULE_TECHNIQUES = {
    "SSH Brute Force": _t("Credential Access", "Brute Force: Password Spraying", "T1110", "T1110.003"),
    "Failed Login": _t("Credential Access", "Brute Force", "T1110"),
    "Kerberos Attack": _t("Credential Access", "Steal or Forge Kerberos Tickets", "T1558"),
    "Sudo Escalation": _t("Privilege Escalation", "Abuse Elevation Control Mechanism: Sudo and Sudo Caching", "T1548", "T1548.003"),
    "Root Login": _t("Privilege Escalation", "Valid Accounts: Local Accounts", "T1078", "T1078.003"),
    "Privilege File Modified": _t("Privilege Escalation", "File and Directory Permissions Modification", "T1222"),
    "SUID Binary": _t("Privilege Escalation", "Abuse Elevation Control Mechanism: Setuid and Setgid", "T1548", "T1548.001"),
    "Log Tampering": _t("Defense Evasion", "Indicator Removal: Clear Linux or Mac System Logs", "T1070", "T1070.002"),
    "Firewall Block": _t("Defense Evasion", "Impair Defenses: Disable or Modify System Firewall", "T1562", "T1562.004"),
    "File Integrity Violation": _t("Defense Evasion", "Indicator Removal on Host", "T1070"),
    "Timestomp": _t("Defense Evasion", "Indicator Removal: Timestomp", "T1070", "T1070.006"),
    "Malware Indicator": _t("Execution", "Command and Scripting Interpreter: Unix Shell", "T1059", "T1059.004"),
    "Reverse Shell Indicator": _t("Execution", "Command and Scripting Interpreter: Unix Shell", "T1059", "T1059.004"),
    "Suspicious Cron": _t("Execution", "Scheduled Task/Job: Cron", "T1053", "T1053.003"),
    "Cron Persistence": _t("Persistence", "Scheduled Task/Job: Cron", "T1053", "T1053.003"),
    "SSH Key Added": _t("Persistence", "Account Manipulation: SSH Authorized Keys", "T1098", "T1098.004"),
    "Startup Script": _t("Persistence", "Boot or Logon Initialization Scripts", "T1037"),
    "Port Scan": _t("Discovery", "Network Service Discovery", "T1046"),
    "Port Scan Detected": _t("Discovery", "Network Service Discovery", "T1046"),
    "Network Discovery": _t("Discovery", "Remote System Discovery", "T1018"),
    "Process Discovery": _t("Discovery", "Process Discovery", "T1057"),
    "File Discovery": _t("Discovery", "File and Directory Discovery", "T1083"),
    "Suspicious Outbound": _t("Command and Control", "Application Layer Protocol", "T1071"),
    "Beaconing Detected": _t("Command and Control", "Application Layer Protocol: Web Protocols", "T1071", "T1071.001"),
    "DNS Tunneling": _t("Command and Control", "Protocol Tunneling", "T1572"),
    "C2 Connection": _t("Command and Control", "Ingress Tool Transfer", "T1105"),
    "Suspicious Network Connection": _t("Command and Control", "Application Layer Protocol", "T1071"),
    "Lateral SSH": _t("Lateral Movement", "Remote Services: SSH", "T1021", "T1021.004"),
    "Pass the Hash": _t("Lateral Movement", "Use Alternate Authentication Material: Pass the Hash", "T1550", "T1550.002"),
    "USB Device": _t("Initial Access", "Replication Through Removable Media", "T1091"),
    "Phishing": _t("Initial Access", "Phishing", "T1566"),
    "Process Crash": _t("Impact", "Endpoint Denial of Service", "T1499"),
    "OOM Killer": _t("Impact", "Endpoint Denial of Service: Service Exhaustion Flood", "T1499", "T1499.002"),
    "Kernel Error": _t("Impact", "Endpoint Denial of Service", "T1499"),
    "Sensitive File Access": _t("Collection", "Data from Local System", "T1005"),
    "Clipboard Capture": _t("Collection", "Clipboard Data", "T1115"),
    "Data Exfiltration": _t("Exfiltration", "Exfiltration Over C2 Channel", "T1041"),
    "Large Outbound Transfer": _t("Exfiltration", "Exfiltration Over Alternative Protocol", "T1048"),
    "Recon Activity": _t("Reconnaissance", "Active Scanning", "T1595"),
}
PORTSCAN_TECHNIQUE = RULE_TECHNIQUES["Port Scan Detected"]

# --- fixed values: text pattern -> technique, first hit wins ---------------------
PATTERN_TECHNIQUES = [
    (r"nmap|masscan|port.?scan|syn.?flood", _t("Discovery", "Network Service Discovery", "T1046")),
    (r"Failed password|Invalid user|authentication failure|pam.*fail", _t("Credential Access", "Brute Force", "T1110")),
    (r"sudo.*COMMAND|su -|runlevel", _t("Privilege Escalation", "Abuse Elevation Control Mechanism: Sudo and Sudo Caching", "T1548", "T1548.003")),
    (r"wget|curl.*http|base64 -d|/tmp/.*\.(sh|py|elf|pl)", _t("Execution", "Command and Scripting Interpreter: Unix Shell", "T1059", "T1059.004")),
    (r"/dev/tcp|mkfifo|nc -e|bash -i|ncat|netcat.*-e", _t("Execution", "Command and Scripting Interpreter: Unix Shell", "T1059", "T1059.004")),
    (r"CRON|crontab", _t("Persistence", "Scheduled Task/Job: Cron", "T1053", "T1053.003")),
    (r"rm.*\.log|shred.*log|truncate.*log|> /var/log", _t("Defense Evasion", "Indicator Removal: Clear Linux or Mac System Logs", "T1070", "T1070.002")),
    (r"UFW BLOCK|IPTABLES.*DROP|firewall.*DENY", _t("Defense Evasion", "Impair Defenses: Disable or Modify System Firewall", "T1562", "T1562.004")),
    (r"session opened for user root|ROOT LOGIN", _t("Privilege Escalation", "Valid Accounts: Local Accounts", "T1078", "T1078.003")),
    (r"segfault|core dump|killed process|signal 11", _t("Impact", "Endpoint Denial of Service", "T1499")),
    (r"usb.*attach|usb.*connect|new.*speed USB", _t("Initial Access", "Replication Through Removable Media", "T1091")),
    (r"Out of memory|oom.kill", _t("Impact", "Endpoint Denial of Service: Service Exhaustion Flood", "T1499", "T1499.002")),
    (r"chmod.*(?:passwd|shadow|sudoers)|chown.*(?:passwd|shadow)", _t("Privilege Escalation", "File and Directory Permissions Modification", "T1222")),
    (r"ssh.*accept|ssh.*session|sshd.*open", _t("Lateral Movement", "Remote Services: SSH", "T1021", "T1021.004")),
]

# --- fixed values: watched file path -> technique, first hit wins ----------------
PATH_TECHNIQUES = [
    (r"/etc/passwd|/etc/shadow|/etc/gshadow", _t("Credential Access", "OS Credential Dumping: /etc/passwd and /etc/shadow", "T1003", "T1003.008")),
    (r"/etc/sudoers|/etc/sudoers\.d", _t("Privilege Escalation", "Abuse Elevation Control Mechanism: Sudo and Sudo Caching", "T1548", "T1548.003")),
    (r"\.ssh/authorized_keys|\.ssh/id_", _t("Persistence", "Account Manipulation: SSH Authorized Keys", "T1098", "T1098.004")),
    (r"/etc/cron|/var/spool/cron", _t("Persistence", "Scheduled Task/Job: Cron", "T1053", "T1053.003")),
    (r"/etc/profile|/etc/bash|\.bashrc|\.profile|\.bash_profile", _t("Persistence", "Boot or Logon Initialization Scripts: RC Scripts", "T1037", "T1037.004")),
    (r"/etc/systemd|/lib/systemd|\.service$", _t("Persistence", "Create or Modify System Process: Systemd Service", "T1543", "T1543.002")),
    (r"/etc/ld\.so|/etc/hosts|/etc/resolv\.conf", _t("Defense Evasion", "Hijack Execution Flow", "T1574")),
    (r"/tmp/|/var/tmp/|/dev/shm/", _t("Execution", "Command and Scripting Interpreter", "T1059")),
    (r"/bin/|/sbin/|/usr/bin/|/usr/sbin/", _t("Defense Evasion", "Masquerading: Invalid Code Signature", "T1036", "T1036.001")),
]

# --- fixed values: destination port -> technique ---------------------------------
PORT_TECHNIQUES = {
    22: _t("Lateral Movement", "Remote Services: SSH", "T1021", "T1021.004"),
    23: _t("Lateral Movement", "Remote Services", "T1021"),
    3389: _t("Lateral Movement", "Remote Services: Remote Desktop Protocol", "T1021", "T1021.001"),
    445: _t("Lateral Movement", "Remote Services: SMB/Windows Admin Shares", "T1021", "T1021.002"),
    139: _t("Lateral Movement", "Remote Services: SMB/Windows Admin Shares", "T1021", "T1021.002"),
    4444: _t("Command and Control", "Application Layer Protocol", "T1071"),
    1337: _t("Command and Control", "Application Layer Protocol", "T1071"),
    6666: _t("Command and Control", "Application Layer Protocol", "T1071"),
    6667: _t("Command and Control", "IRC", "T1071"),
    53: _t("Command and Control", "Protocol Tunneling", "T1572"),
    80: _t("Command and Control", "Application Layer Protocol: Web Protocols", "T1071", "T1071.001"),
    443: _t("Command and Control", "Application Layer Protocol: Web Protocols", "T1071", "T1071.001"),
    8080: _t("Command and Control", "Application Layer Protocol: Web Protocols", "T1071", "T1071.001"),
    25: _t("Exfiltration", "Exfiltration Over Alternative Protocol", "T1048"),
    587: _t("Exfiltration", "Exfiltration Over Alternative Protocol", "T1048"),
}

# --- fixed values: technique id -> description shown with an alert ----------------
TECHNIQUE_DESCRIPTIONS = {
    "T1110": "Adversary attempting to gain access by guessing passwords.",
    "T1046": "Adversary scanning to discover services on remote hosts.",
    "T1059": "Adversary abusing command-line interfaces to execute commands.",
    "T1053": "Adversary abusing task scheduling for persistent execution.",
    "T1070": "Adversary deleting or altering artifacts to remove evidence.",
    "T1562": "Adversary disabling security tools or logging.",
    "T1548": "Adversary circumventing elevation controls for higher permissions.",
    "T1078": "Adversary using compromised credentials for authentication.",
    "T1098": "Adversary manipulating accounts to maintain access.",
    "T1071": "Adversary using standard protocols to blend C2 traffic.",
    "T1572": "Adversary tunneling data inside application-layer protocols.",
    "T1003": "Adversary attempting to dump credentials from the OS.",
    "T1222": "Adversary modifying file permissions on sensitive files.",
    "T1021": "Adversary using valid accounts to log into remote services.",
    "T1091": "Adversary spreading using removable media.",
    "T1543": "Adversary installing malicious services for persistence.",
    "T1105": "Adversary transferring tools from external system.",
    "T1499": "Adversary performing DoS to degrade or block service.",
}

# --- fixed values: multi-stage chains, first satisfied chain fires -----------------
CHAINS = [
    Chain("Reconnaissance to Compromise", ("Discovery", "Credential Access", "Privilege Escalation"), 60, "CRITICAL",
          "Full attack chain observed: network discovery followed by credential attack and privilege escalation from the same source."),
    Chain("Initial Access to Persistence", ("Initial Access", "Execution", "Persistence"), 90, "CRITICAL",
          "Attacker gained initial access, executed code, and established persistence mechanisms."),
    Chain("Credential Theft to Lateral Movement", ("Credential Access", "Lateral Movement"), 45, "CRITICAL",
          "Credential theft followed by lateral movement — possible pass-the-hash or stolen SSH key use."),
    Chain("Defense Evasion Campaign", ("Defense Evasion", "Privilege Escalation"), 30, "CRITICAL",
          "Security controls disabled or tampered with, combined with privilege escalation — active hands-on intrusion likely."),
    Chain("Data Exfiltration Attempt", ("Collection", "Exfiltration"), 60, "CRITICAL",
          "Data collection activity followed by exfiltration attempt."),
    Chain("C2 Established", ("Execution", "Command and Control"), 30, "CRITICAL",
          "Remote code execution followed by command-and-control communication — likely active backdoor."),
    Chain("Port Scan to Brute Force", ("Discovery", "Credential Access"), 20, "WARNING",
          "Port scan from source immediately followed by authentication attacks — automated attack tool likely."),
    Chain("Log Tampering After Intrusion", ("Privilege Escalation", "Defense Evasion"), 30, "CRITICAL",
          "Privilege escalation followed by log tampering or defence evasion — attacker covering tracks."),
    Chain("Persistence to Exfiltration", ("Persistence", "Collection", "Exfiltration"), 120, "CRITICAL",
          "Long-term access pattern: persistence established, data collected, then exfiltrated."),
]

# --- fixed values: ports and addresses --------------------------------------------
SUSPICIOUS_PORTS = {
    4444: "Metasploit default listener",
    4445: "Metasploit alt listener",
    1337: "L33t/hacker convention port",
    31337: "Back Orifice / classic backdoor",
    6666: "IRC / backdoor convention",
    6667: "IRC unencrypted",
    6668: "IRC alt",
    1234: "Generic backdoor",
    5555: "ADB / Android debug / generic backdoor",
    9001: "Tor relay port",
    9050: "Tor SOCKS proxy",
    9051: "Tor control port",
    8888: "Jupyter / potential web shell",
    2222: "SSH alt – possible pivoting",
    8443: "HTTPS alt – common C2",
    12345: "Classic backdoor (NetBus era)",
    27374: "SubSeven trojan",
    65535: "Common exploit/scan probe port",
}
SMTP_PORTS = [25, 465, 587]
SKIP_PREFIXES = ["127.", "0.0.0.0", "::1", "::"]
SOCKET_SCAN_STATES = ["02", "06"]

# --- fixed values: firewall and login patterns that reveal a probe (regex, kind) ------
SCAN_PATTERNS = [
    (r"UFW BLOCK.*?SRC=(\d{1,3}(?:\.\d{1,3}){3}).*?DPT=(\d+)", "firewall"),
    (r"(?:DROP|REJECT|BLOCK).*?SRC=(\d{1,3}(?:\.\d{1,3}){3}).*?DPT=(\d+)", "firewall"),
    (r"ip\s+saddr\s+(\d{1,3}(?:\.\d{1,3}){3})\s+.*?dport\s+(\d+)", "firewall"),
    (r"SYN flood.*?from\s+(\d{1,3}(?:\.\d{1,3}){3})\s+port\s+(\d+)", "synflood"),
    (r"(?:Failed|Invalid).*?from\s+(\d{1,3}(?:\.\d{1,3}){3})\s+port\s+(\d+)", "auth"),
    (r"from\s+(\d{1,3}(?:\.\d{1,3}){3})(?:\s+port\s+(\d+))?", "log"),
    (r"SRC=(\d{1,3}(?:\.\d{1,3}){3}).*?DPT=(\d+)", "firewall"),
]

# --- fixed values: DNS ------------------------------------------------------------
BAD_TLDS = [".onion", ".bit", ".bazar", ".coin", ".lib", ".emc", ".chan", ".fur", ".locker"]
DNS_PATTERNS = [
    r"query\[(?:A+|AAAA)\]\s+([\w.\-]+)\s+from\s+([\d.]+)",
    r"query for\s+([\w.\-]+)(?:\s+from\s+([\d.]+))?",
    r"client\s+([\d.]+)#\d+.*query:\s+([\w.\-]+)",
    r"NXDOMAIN.*?([\w.\-]{10,})",
    r"resolved\s+([\w.\-]+)\s+to",
]
DNS_GROUPS = [2, 2, 2, 1, 1]
DNS_ENTROPY_THRESHOLD = 3.8
DNS_ENTROPY_MIN_LENGTH = 10
DNS_LENGTH_THRESHOLD = 50
DNS_RATE_THRESHOLD = 30
DNS_RATE_CAP = 500
NXDOMAIN_THRESHOLD = 15
NXDOMAIN_CAP = 200

# --- fixed values: processes ---------------------------------------------------------
SUSPICIOUS_PARENTS = [
    "apache2", "httpd", "nginx", "lighttpd",
    "php", "php-fpm", "php7", "php8",
    "tomcat", "catalina", "java",
    "python", "python3", "ruby", "perl",
    "node", "nodejs",
    "mysqld", "postgres", "mongod",
    "vsftpd", "proftpd", "pure-ftpd",
]
SUSPICIOUS_CHILDREN = [
    "bash", "sh", "dash", "zsh", "ksh",
    "nc", "ncat", "netcat", "nmap",
    "wget", "curl",
    "python", "python3", "perl", "ruby",
    "gcc", "g++", "cc",
    "chmod", "chown", "chattr",
    "crontab",
    "su", "sudo",
    "socat", "msfconsole", "metasploit",
]
TEMP_DIR_PATTERN = r"^(/tmp|/var/tmp|/dev/shm|/run/shm)/"
BAD_PROCESSES = [
    "xmrig", "minerd", "cpuminer", "cgminer",
    "mimikatz", "msfvenom", "msfconsole",
    "reverse_shell", "bindshell",
]
CPU_THRESHOLD = 80.0

# --- fixed values: source formats ------------------------------------------------------
SYSLOG_PATTERN = r"^(\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+\S+\s+(\S+?)(?:\[\d+\])?:\s*(.*)"
JOURNALD_PRIORITY = {"0": "CRITICAL", "1": "CRITICAL", "2": "CRITICAL", "3": "ERROR",
                     "4": "WARNING", "5": "INFO", "6": "INFO", "7": "DEBUG"}
UNIFIED_LOG_LEVEL = {"Default": "INFO", "Info": "INFO", "Debug": "DEBUG", "Error": "ERROR", "Fault": "CRITICAL"}
WINDOWS_TEXT_LEVEL = {"information": "INFO", "verbose": "DEBUG", "warning": "WARNING",
                      "error": "ERROR", "critical": "CRITICAL"}
WINDOWS_EVENT_TYPE = {1: "ERROR", 2: "WARNING", 4: "INFO", 8: "INFO", 16: "WARNING"}

# --- fixed values: log sources (path, name, enabled) and watched paths -------------------
LINUX_SOURCES = [
    ("/var/log/syslog", "syslog", True),
    ("/var/log/auth.log", "auth", True),
    ("/var/log/kern.log", "kernel", True),
    ("/var/log/messages", "messages", False),
    ("/var/log/secure", "secure", False),
    ("/var/log/apache2/access.log", "apache_access", False),
    ("/var/log/apache2/error.log", "apache_error", False),
    ("/var/log/nginx/access.log", "nginx_access", False),
    ("/var/log/nginx/error.log", "nginx_error", False),
]
MACOS_SOURCES = [
    ("/var/log/system.log", "system", True),
    ("/var/log/install.log", "install", False),
]
WINDOWS_CHANNELS = ["System", "Application", "Security", "Microsoft-Windows-PowerShell/Operational"]
WATCHED_PATHS = [
    "/etc/passwd", "/etc/shadow", "/etc/gshadow", "/etc/group",
    "/etc/sudoers", "/etc/sudoers.d",
    "/etc/ssh/sshd_config", "/root/.ssh/authorized_keys",
    "/etc/crontab", "/etc/cron.d", "/etc/profile", "/etc/bash.bashrc", "/etc/environment",
    "/etc/systemd/system", "/lib/systemd/system",
    "/etc/hosts", "/etc/resolv.conf", "/etc/nsswitch.conf",
    "/etc/ld.so.conf", "/etc/ld.so.preload",
    "/etc/pam.conf", "/etc/pam.d",
    "/usr/bin/sudo", "/usr/bin/su", "/bin/login",
]

# --- fixed values: retention and notifications --------------------------------------------
RETENTION_DAYS = {"DEBUG": 7, "INFO": 7, "WARNING": 30, "ERROR": 90, "CRITICAL": None}
ALERT_RETENTION_DAYS = 30
LEVEL_EMOJI = {"DEBUG": "🔵", "INFO": "🟢", "WARNING": "🟡", "ERROR": "🟠", "CRITICAL": "🔴"}
LEVEL_COLOUR = {"DEBUG": "#607080", "INFO": "#00d4ff", "WARNING": "#ffd740", "ERROR": "#ff7043", "CRITICAL": "#ff1744"}

# --- fixed values: windows, gaps and thresholds ---------------------------------------------
RATE_WINDOW_SECONDS = 60
SCAN_PORT_THRESHOLD = 12
SCAN_WINDOW_SECONDS = 60
SCAN_COOLDOWN_SECONDS = 300
DNS_COOLDOWN_SECONDS = 300
ALERT_COOLDOWN_SECONDS = 120
CONNECTION_GRACE_SECONDS = 300
FOREST_TREES = 100
FOREST_SAMPLE = 256
FOREST_TRAIN_SIZE = 800
FOREST_MIN_BUFFER = 100
FOREST_CONTAMINATION = 0.05
FOREST_THRESHOLD = -0.10
FOREST_SEED = 42
