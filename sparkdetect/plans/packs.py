"""Bundled rules, correlations and controls, as data."""

from __future__ import annotations

from ..operators.rules import Correlation, Rule


# Titles, selections, names, patterns and thresholds of the rules and correlations.
RULES = (
    Rule("SD-0001", {
        "selection_process": {"process.name|endswith": ["powershell.exe", "pwsh.exe"]},
        "selection_encoded": {"process.command_line|re": r"\s-(enc|encodedcommand|e)\s"},
        "selection_conceal": {"process.command_line|re": r"\s-(w|windowstyle)\s+hidden|\s-noni\b|\s-nop\b"},
    }, "selection_process and selection_encoded and selection_conceal", "Encoded PowerShell Command Execution", "high", ("T1059.001",), "execution"),
    Rule("SD-0003", {
        "selection_vssadmin": {"process.command_line|re": r'v[\s"^]*s[\s"^]*s[\s"^]*a[\s"^]*d[\s"^]*m[\s"^]*i[\s"^]*n.{0,20}d[\s"^]*e[\s"^]*l[\s"^]*e[\s"^]*t[\s"^]*e.{0,10}s[\s"^]*h[\s"^]*a[\s"^]*d[\s"^]*o[\s"^]*w'},
        "selection_wmic": {"process.command_line|re": r's[\s"^]*h[\s"^]*a[\s"^]*d[\s"^]*o[\s"^]*w[\s"^]*c[\s"^]*o[\s"^]*p[\s"^]*y.{0,10}d[\s"^]*e[\s"^]*l[\s"^]*e[\s"^]*t[\s"^]*e'},
        "selection_bcdedit": {"process.command_line|re": r'r[\s"^]*e[\s"^]*c[\s"^]*o[\s"^]*v[\s"^]*e[\s"^]*r[\s"^]*y[\s"^]*e[\s"^]*n[\s"^]*a[\s"^]*b[\s"^]*l[\s"^]*e[\s"^]*d.{0,6}n[\s"^]*o|b[\s"^]*o[\s"^]*o[\s"^]*t[\s"^]*s[\s"^]*t[\s"^]*a[\s"^]*t[\s"^]*u[\s"^]*s[\s"^]*p[\s"^]*o[\s"^]*l[\s"^]*i[\s"^]*c[\s"^]*y.{0,6}i[\s"^]*g[\s"^]*n[\s"^]*o[\s"^]*r[\s"^]*e'},
        "selection_wbadmin": {"process.command_line|re": r'd[\s"^]*e[\s"^]*l[\s"^]*e[\s"^]*t[\s"^]*e.{0,10}c[\s"^]*a[\s"^]*t[\s"^]*a[\s"^]*l[\s"^]*o[\s"^]*g'},
    }, "1 of selection_*", "Recovery Inhibition via Shadow Copy or Backup Catalog Deletion", "critical", ("T1490",), "impact"),
    Rule("SD-0004", {
        "selection_disable": {"process.command_line|contains": ["DisableRealtimeMonitoring $true", "DisableIOAVProtection $true", "DisableBehaviorMonitoring $true", "MpPreference -DisableScriptScanning $true"]},
        "selection_exclusion": {"process.command_line|contains": "Add-MpPreference"},
        "selection_exclusion_target": {"process.command_line|contains": ["-ExclusionPath", "-ExclusionExtension", "-ExclusionProcess"]},
    }, "selection_disable or (selection_exclusion and selection_exclusion_target)", "Microsoft Defender Tampering via PowerShell", "high", ("T1562.001",), "defense-evasion"),
    Rule("SD-0005", {"selection": {"event_type": "wmi_event", "wmi.operation|contains": ["EventConsumerCreated", "EventFilterCreated", "FilterToConsumerBindingCreated"]}}, "selection", "WMI Permanent Event Subscription Persistence", "high", ("T1546.003",), "persistence"),
    Rule("SD-0006", {
        "selection_net": {"process.name|endswith": "net.exe", "process.command_line|re": r"(group|user)\s+.*(/domain|domain admins)"},
        "selection_tools": {"process.name|endswith": ["nltest.exe", "dsquery.exe", "adfind.exe"]},
        "selection_script_parent": {"process.parent_name|endswith": ["powershell.exe", "pwsh.exe", "wscript.exe", "cscript.exe", "mshta.exe"]},
    }, "(selection_net or selection_tools) and selection_script_parent", "Domain Reconnaissance via Built-in Utilities", "medium", ("T1087.002",), "discovery"),
    Rule("SD-0007", {
        "selection_parent": {"process.parent_name|endswith": ["WINWORD.EXE", "EXCEL.EXE", "POWERPNT.EXE", "OUTLOOK.EXE", "MSACCESS.EXE"]},
        "selection_child": {"process.name|endswith": ["powershell.exe", "pwsh.exe", "cmd.exe", "wscript.exe", "cscript.exe", "mshta.exe", "regsvr32.exe", "rundll32.exe"]},
    }, "selection_parent and selection_child", "Office Application Spawning Script Interpreter", "high", ("T1059.001",), "execution"),
    Rule("SD-0008", {
        "selection_named": {"process.name|startswith": ["psexec", "paexec", "csexec"]},
        "selection_cmdline_shape": {"process.command_line|re": r"\\\\[A-Za-z0-9._-]+\s+.*-u\s"},
        "selection_admin_share": {"event_type": "file_share_access", "file.share_name|contains": "ADMIN$"},
    }, "selection_named or selection_cmdline_shape or selection_admin_share", "Remote Execution via PsExec-style Service Installation", "high", ("T1021.002",), "lateral-movement"),
    Rule("SD-0009", {
        "selection_burst": {"event_type": "file_modification_burst", "file.modified_count|gte": 500, "file.entropy_avg|gte": 7.5},
        "selection_ransom_note": {"event_type": "file_create", "file.path|re": r"(restore|recover|readme|how[_-]?to[_-]?decrypt).*\.(txt|hta|html)$"},
    }, "selection_burst or selection_ransom_note", "Mass File Modification Consistent with Encryption", "critical", ("T1486",), "impact"),
    Rule("SD-0010", {
        "selection_rdp_success": {"event_type": "authentication", "winlog.event_id": 4624, "winlog.logon_type": 10},
        "filter_internal": {"source.ip|re": r"^(10\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[01])\.|127\.)"},
    }, "selection_rdp_success and not filter_internal", "Interactive RDP Logon from External Address", "high", ("T1133",), "initial-access"),
)
CORRELATIONS = (
    Correlation("SC-0001", "sequence", 3600, "user", (
        {"event_type|in": ["repo_clone_burst", "query_executed", "file_copy_to_removable"]},
        {"event_type|in": ["http_upload", "file_copy_to_removable"], "network.bytes_out|gte": 100000000},
    ), title="Insider Data Collection Followed by Exfiltration", severity="high", techniques=("T1567.002",), tactic="exfiltration"),
    Correlation("SC-0002", "sequence", 900, "host", (
        {"event_type": "process_creation", "process.name|endswith": ["powershell.exe", "pwsh.exe", "wscript.exe", "cscript.exe", "mshta.exe"]},
        {"event_type": "process_access", "process.target_name|endswith": ["lsass.exe", "winlogon.exe", "services.exe"]},
    ), (None, {"process.name|endswith": ["MsMpEng.exe", "CcmExec.exe"]}), title="Kill Chain Progression from Execution to Credential Access", severity="critical", techniques=("T1134.001",), tactic="credential-access"),
    Correlation("SC-0003", "threshold", 300, "host", select={"event_type": "authentication", "winlog.event_id": 4625, "winlog.logon_type": 10}, threshold=5, title="RDP Authentication Brute Force", severity="medium", techniques=("T1110.001",), tactic="credential-access"),
    Correlation("SC-0004", "distinct", 600, "host", select={"event_type|in": ["network_connection", "network_scan"]}, threshold=25, distinct_field="destination.ip", title="Internal Network Sweep from a Single Source", severity="medium", techniques=("T1046",), tactic="discovery"),
)

_N, _C, _I = "NIST SP 800-53", "NIST CSF 2.0", "ISO/IEC 27001:2022"
CONTROLS = [
    (_N, "AC-2", "Account Management", ["T1087.002", "T1134.001"]), (_N, "AC-3", "Access Enforcement", ["T1134.001", "T1021.002"]), (_N, "AC-17", "Remote Access", ["T1133", "T1021.002"]),
    (_N, "AU-6", "Audit Record Review, Analysis, and Reporting", ["T1562.001", "T1213"]), (_N, "CM-7", "Least Functionality", ["T1059.001", "T1546.003", "T1560.001"]), (_N, "CP-9", "System Backup", ["T1490", "T1486"]),
    (_N, "CP-10", "System Recovery and Reconstitution", ["T1490"]), (_N, "IA-5", "Authenticator Management", ["T1003.001", "T1110.001"]), (_N, "SC-7", "Boundary Protection", ["T1041", "T1567.002", "T1046"]),
    (_N, "SI-3", "Malicious Code Protection", ["T1566.001", "T1059.001", "T1486", "T1562.001"]), (_N, "SI-4", "System Monitoring", ["T1046", "T1087.002", "T1021.002", "T1213.003"]), (_N, "MP-7", "Media Use", ["T1052.001"]),
    (_C, "ID.RA-01", "Vulnerabilities in assets are identified", ["T1046", "T1133"]), (_C, "PR.AA-05", "Access permissions enforce least privilege", ["T1134.001", "T1087.002"]),
    (_C, "PR.DS-01", "Confidentiality of data-at-rest is protected", ["T1213", "T1213.003", "T1486"]), (_C, "PR.DS-02", "Confidentiality of data-in-transit is protected", ["T1041", "T1567.002", "T1052.001"]),
    (_C, "PR.PS-01", "Configuration management practices are established", ["T1562.001", "T1546.003"]), (_C, "DE.CM-01", "Networks are monitored to find adverse events", ["T1046", "T1041", "T1021.002"]),
    (_C, "DE.CM-03", "Personnel activity is monitored for adverse events", ["T1213.003", "T1052.001", "T1567.002"]), (_C, "DE.CM-09", "Computing hardware and software are monitored", ["T1059.001", "T1003.001", "T1566.001", "T1560.001"]),
    (_C, "DE.AE-02", "Adverse events are analysed to understand attack targets", ["T1134.001", "T1490"]), (_C, "RC.RP-01", "Recovery portion of the response plan is executed", ["T1490", "T1486"]),
    (_I, "A.5.15", "Access control", ["T1134.001", "T1087.002", "T1021.002"]), (_I, "A.5.17", "Authentication information", ["T1003.001", "T1110.001"]), (_I, "A.6.8", "Information security event reporting", ["T1562.001"]),
    (_I, "A.7.10", "Storage media", ["T1052.001"]), (_I, "A.8.7", "Protection against malware", ["T1566.001", "T1059.001", "T1486"]), (_I, "A.8.12", "Data leakage prevention", ["T1041", "T1567.002", "T1213", "T1213.003", "T1560.001"]),
    (_I, "A.8.13", "Information backup", ["T1490", "T1486"]), (_I, "A.8.16", "Monitoring activities", ["T1046", "T1021.002", "T1134.001"]), (_I, "A.8.20", "Networks security", ["T1133", "T1046", "T1041"]), (_I, "A.8.21", "Security of network services", ["T1133", "T1021.002"]),
]
