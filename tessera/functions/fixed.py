"""Lists and patterns that results depend on. Patterns are in Java's dialect."""

from __future__ import annotations

# Domains of free mail services.
FREE_MAIL_DOMAINS = [
    "gmail.com", "yahoo.com", "hotmail.com", "outlook.com", "aol.com", "icloud.com", "mail.com", "zoho.com", "protonmail.com",
    "yandex.com", "gmx.com", "gmx.net", "live.com", "msn.com", "inbox.com", "fastmail.com", "tutanota.com", "hushmail.com",
    "mailfence.com", "disroot.org", "riseup.net", "posteo.de", "mailbox.org", "yahoo.co.uk", "yahoo.co.in", "hotmail.co.uk",
    "live.co.uk", "rediffmail.com", "qq.com", "163.com", "126.com",
]

# Codes of countries, their continent and region.
COUNTRY_REGIONS = {
    "US": ("North America", "Northern America"),
    "CA": ("North America", "Northern America"),
    "MX": ("North America", "Central America"),
    "BR": ("South America", "South America"),
    "AR": ("South America", "South America"),
    "CL": ("South America", "South America"),
    "CO": ("South America", "South America"),
    "PE": ("South America", "South America"),
    "GB": ("Europe", "Northern Europe"),
    "UK": ("Europe", "Northern Europe"),
    "DE": ("Europe", "Western Europe"),
    "FR": ("Europe", "Western Europe"),
    "IT": ("Europe", "Southern Europe"),
    "ES": ("Europe", "Southern Europe"),
    "PT": ("Europe", "Southern Europe"),
    "NL": ("Europe", "Western Europe"),
    "BE": ("Europe", "Western Europe"),
    "CH": ("Europe", "Western Europe"),
    "AT": ("Europe", "Western Europe"),
    "SE": ("Europe", "Northern Europe"),
    "NO": ("Europe", "Northern Europe"),
    "DK": ("Europe", "Northern Europe"),
    "FI": ("Europe", "Northern Europe"),
    "IE": ("Europe", "Northern Europe"),
    "PL": ("Europe", "Eastern Europe"),
    "CZ": ("Europe", "Eastern Europe"),
    "RO": ("Europe", "Eastern Europe"),
    "HU": ("Europe", "Eastern Europe"),
    "RU": ("Europe", "Eastern Europe"),
    "UA": ("Europe", "Eastern Europe"),
    "GR": ("Europe", "Southern Europe"),
    "TR": ("Asia", "Western Asia"),
    "CN": ("Asia", "Eastern Asia"),
    "JP": ("Asia", "Eastern Asia"),
    "KR": ("Asia", "Eastern Asia"),
    "IN": ("Asia", "Southern Asia"),
    "PK": ("Asia", "Southern Asia"),
    "BD": ("Asia", "Southern Asia"),
    "ID": ("Asia", "South-Eastern Asia"),
    "TH": ("Asia", "South-Eastern Asia"),
    "VN": ("Asia", "South-Eastern Asia"),
    "MY": ("Asia", "South-Eastern Asia"),
    "SG": ("Asia", "South-Eastern Asia"),
    "PH": ("Asia", "South-Eastern Asia"),
    "AE": ("Asia", "Western Asia"),
    "SA": ("Asia", "Western Asia"),
    "IL": ("Asia", "Western Asia"),
    "AU": ("Oceania", "Australia and New Zealand"),
    "NZ": ("Oceania", "Australia and New Zealand"),
    "ZA": ("Africa", "Southern Africa"),
    "NG": ("Africa", "Western Africa"),
    "KE": ("Africa", "Eastern Africa"),
    "EG": ("Africa", "Northern Africa"),
    "MA": ("Africa", "Northern Africa"),
    "GH": ("Africa", "Western Africa"),
    "TZ": ("Africa", "Eastern Africa"),
    "ET": ("Africa", "Eastern Africa"),
}

# Names of countries and their codes.
COUNTRY_NAMES = {
    "united states": "US",
    "usa": "US",
    "united states of america": "US",
    "canada": "CA",
    "mexico": "MX",
    "brazil": "BR",
    "argentina": "AR",
    "chile": "CL",
    "colombia": "CO",
    "peru": "PE",
    "united kingdom": "GB",
    "uk": "GB",
    "great britain": "GB",
    "england": "GB",
    "germany": "DE",
    "france": "FR",
    "italy": "IT",
    "spain": "ES",
    "portugal": "PT",
    "netherlands": "NL",
    "belgium": "BE",
    "switzerland": "CH",
    "austria": "AT",
    "sweden": "SE",
    "norway": "NO",
    "denmark": "DK",
    "finland": "FI",
    "ireland": "IE",
    "poland": "PL",
    "czech republic": "CZ",
    "czechia": "CZ",
    "romania": "RO",
    "hungary": "HU",
    "russia": "RU",
    "ukraine": "UA",
    "greece": "GR",
    "turkey": "TR",
    "china": "CN",
    "japan": "JP",
    "south korea": "KR",
    "korea": "KR",
    "india": "IN",
    "pakistan": "PK",
    "bangladesh": "BD",
    "indonesia": "ID",
    "thailand": "TH",
    "vietnam": "VN",
    "malaysia": "MY",
    "singapore": "SG",
    "philippines": "PH",
    "united arab emirates": "AE",
    "uae": "AE",
    "saudi arabia": "SA",
    "israel": "IL",
    "australia": "AU",
    "new zealand": "NZ",
    "south africa": "ZA",
    "nigeria": "NG",
    "kenya": "KE",
    "egypt": "EG",
    "morocco": "MA",
    "ghana": "GH",
    "tanzania": "TZ",
    "ethiopia": "ET",
}

# Names and prefixes of fields that say nothing about a record.
METADATA_FIELDS = [
    "attributes.type", "attributes.url", "attributes.referenceId", "links", "self", "next", "previous", "meta", "pagination", "cursor",
    "nextPageToken", "prevPageToken", "totalSize", "done", "nextRecordsUrl", "@odata.context", "@odata.type", "@odata.id", "_links",
    "_embedded", "_metadata",
]

# Keys under which responses wrap their records, in order of preference.
RECORD_KEYS = [
    "records", "data", "results", "items", "entries", "rows", "hits", "documents", "objects", "values", "elements", "content",
    "payload", "response", "body",
]

# Severities by their other names, and their order.
SEVERITIES = {
    "TRACE": "DEBUG", "DEBUG": "DEBUG", "INFO": "INFO", "INFORMATION": "INFO", "NOTICE": "INFO", "WARN": "WARNING", "WARNING": "WARNING",
    "ERR": "ERROR", "ERROR": "ERROR", "CRIT": "CRITICAL", "CRITICAL": "CRITICAL", "FATAL": "FATAL", "EMERG": "FATAL", "EMERGENCY": "FATAL",
    "ALERT": "CRITICAL", "PANIC": "FATAL",
}
SEVERITY_RANKS = {"DEBUG": 0, "INFO": 1, "WARNING": 2, "ERROR": 3, "CRITICAL": 4, "FATAL": 4, "UNKNOWN": -1}

# Names of columns that hold ids, mail addresses, dates and phone numbers (searched, any case).
ID_NAME = r"^(id|.*_id|.*id$|key|.*_key|uuid|guid)"
EMAIL_NAME = r"(email|e_mail|e-mail|mail|email_address)"
DATE_NAME = r"(date|datetime|timestamp|created|updated|modified|_at$|_on$|_dt$|dob|birth)"
PHONE_NAME = r"(phone|mobile|cell|tel|fax|contact_number)"
EMAIL = r"^[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}$"

# What stands for a missing cell in a CSV file.
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

# Classes of personal data, tried in this order.
PERSONAL_DATA = [
    ("email", r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"),
    ("phone", r"^[\+]?[(]?[0-9]{1,4}[)]?[-\s\./0-9]{7,15}$"),
    ("ssn", r"^\d{3}-?\d{2}-?\d{4}$"),
    ("credit_card", r"^\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}$"),
    ("ip_address", r"^(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)$"),
]

# Variable parts of messages and what replaces them, in order.
VARIABLE_PARTS = [
    (r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?", "{timestamp}"),
    (r"\b[\w\.\-]+@[\w\.\-]+\.\w+\b", "{email}"),
    (r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b", "{uuid}"),
    (r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "{ip}"),
    (r"\b[0-9a-fA-F]{1,4}(:[0-9a-fA-F]{1,4}){7}\b", "{ipv6}"),
    (r"\b0x[0-9a-fA-F]+\b", "{hex}"),
    (r":(\d{2,5})\b", ":{port}"),
    (r"(/[\w\-\.]+)+/?", "{path}"),
    (r"\b\d+\b", "{n}"),
]

# Formats of log lines.
LINE_JSON = r"^\s*\{.*\}\s*$"
LINE_STANDARD = r"^(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}(?:\.\d+)?)\s+([A-Z]+)\s+\[([^\]]+)\]\s+(.+)$"
LINE_BRACKET_ISO = r"^\[(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?Z?(?:[+-]\d{2}:?\d{2})?)\]\s+([A-Z]+)\s+([\w\-\.]+):\s+(.+)$"
LINE_ISO_FLEX = r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?)\s+([A-Z]+)\s+(?:(?:\[([^\]]+)\]|([\w\-\.]+):)\s+)?(.+)$"
LINE_ACCESS = r'^(\S+)\s+\S+\s+\S+\s+\[(\d{2}/[A-Z][a-z]{2}/\d{4}:\d{2}:\d{2}:\d{2}\s+[+-]\d{4})\]\s+"([^"]*)"\s+(\d{3})\s+(\S+)(?:\s+"([^"]*)"\s+"([^"]*)")?'
LINE_SYSLOG = r"^([A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+([\w\-\.]+)\s+([\w\-\.]+)(?:\[(\d+)\])?:\s+(.+)$"
SYSLOG_SEVERITY = r"(?i)^(DEBUG|INFO|WARN(?:ING)?|ERR(?:OR)?|CRIT(?:ICAL)?|FATAL|EMERG)\b[:\s]*(.+)"
FALLBACK_SEVERITIES = ["FATAL", "CRITICAL", "ERROR", "WARNING", "WARN", "INFO", "DEBUG"]
LINE_SERVICE = r"\[([a-zA-Z][\w\-\.]*)\]"
LOG_EXTENSIONS = [".log", ".txt", ".out", ".err"]

# Fields of invoices.
INVOICE_NUMBERS = [
    r"(?i)(?:Invoice\s*#|Invoice\s*No\.?\s*|INV[-–])\s*([A-Za-z0-9\-]+)",
    r"(?i)(?:Bill\s*#|Bill\s*No\.?\s*)\s*([A-Za-z0-9\-]+)",
    r"(?i)(?:Receipt\s*#|Receipt\s*No\.?\s*)\s*([A-Za-z0-9\-]+)",
    r"(?i)\b(INV[-–]\d{4}[-–]\d{3,})\b",
    r"(?i)(?:Invoice\s*Number\s*[:\-]?\s*)([A-Za-z0-9\-]+)",
]
MONTHS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
DATES = [
    r"\b(\d{4}[-/]\d{1,2}[-/]\d{1,2})\b",
    r"\b(\d{1,2}[-/]\d{1,2}[-/]\d{4})\b",
    rf"(?i)\b(\d{{1,2}}\s+(?:{MONTHS})[a-z]*\.?\s+\d{{4}})\b",
    rf"(?i)\b((?:{MONTHS})[a-z]*\.?\s+\d{{1,2}},?\s+\d{{4}})\b",
]
INVOICE_DATE_LABEL = r"(?:Invoice\s*Date|Date\s*of\s*Invoice|Issue\s*Date|Issued\s*On|Date)\s*[:\-]?\s*"
DUE_DATE_LABEL = r"(?:Due\s*Date|Payment\s*Due|Pay\s*By|Due\s*On|Due)\s*[:\-]?\s*"
CURRENCY_SIGNS = [("$", "USD"), ("€", "EUR"), ("£", "GBP"), ("¥", "JPY"), ("₹", "INR"), ("₩", "KRW"), ("₽", "RUB"), ("R$", "BRL"), ("CHF", "CHF"), ("A$", "AUD"), ("C$", "CAD"), ("kr", "SEK")]
CURRENCY_CODES = r"(?i)\b(USD|EUR|GBP|JPY|INR|CAD|AUD|CHF|SEK|NOK|DKK|BRL|KRW|RUB|CNY|HKD|SGD|NZD|MXN|ZAR)\b"
SUBTOTAL = r"(?i)(?:Sub\s*[-]?\s*Total|Subtotal)\s*[:\-]?\s*[^\d]*([\d,]+\.?\d*)"
TAX = r"(?i)(?:Tax|VAT|GST|Sales\s*Tax|HST)\s*(?:\(?\d+\.?\d*%?\)?)?\s*[:\-]?\s*[^\d]*([\d,]+\.?\d*)"
TOTAL = r"(?i)(?:Grand\s*Total|Total\s*Due|Total\s*Amount|Amount\s*Due|Balance\s*Due|Total)\s*[:\-]?\s*[^\d]*([\d,]+\.?\d*)"
TAX_IDS = [r"(?i)(?:Tax\s*ID|TIN|VAT\s*(?:No|Number|ID|Reg)|EIN|ABN|GST\s*(?:No|Number|Reg))\s*[:\-]?\s*([A-Za-z0-9\-\.]+)", r"\b([A-Z]{2}[-]?\d{2}[-]?\d{7,})\b"]
VENDOR_LABEL = r"(?i)(?:From|Seller|Vendor|Bill\s*From|Sold\s*By|Supplier)\s*[:\-]?\s*"
BUYER_LABEL = r"(?i)(?:To|Buyer|Bill\s*To|Sold\s*To|Ship\s*To|Customer|Client)\s*[:\-]?\s*"
SECTION_END = r"(?i)^(?:From|To|Seller|Buyer|Bill|Sold|Ship|Invoice|Date|Due|Tax|Sub|Total|Item|Qty|Description)"
LINE_ITEM = r"(?m)^(.+?)\s+(\d+(?:\.\d+)?)\s+[\$€£¥₹]?([\d,]+\.?\d*)\s+[\$€£¥₹]?([\d,]+\.?\d*)\s*$"
SUMMARY_WORDS = ["subtotal", "sub total", "total", "tax", "vat", "gst", "grand total", "discount"]
ITEM_HEADERS = {
    "description": ["description", "item", "product", "service", "particulars", "detail"],
    "quantity": ["qty", "quantity", "units", "count", "no"],
    "unit_price": ["unit price", "price", "rate", "unit cost", "unit_price"],
    "total": ["total", "amount", "line total", "ext", "extended", "line_total"],
}

# What is advised about kinds of error patterns: their count, then their services or their beginning.
ADVICE = {
    "connection": "ConnectionTimeout errors (%d occurrences) suggest network connectivity issues — check network routes, firewall rules, and target service health",
    "null": "Null reference errors (%d occurrences) in %s — review recent code deployments for missing null checks",
    "memory": "Memory errors (%d occurrences) — consider increasing heap size, checking for memory leaks, or scaling horizontally",
    "timeout": "Timeout errors (%d occurrences) — review service SLAs, increase timeout thresholds, or investigate downstream latency",
    "permission": "Permission/authorization errors (%d occurrences) — verify IAM policies, API keys, and service account permissions",
    "storage": "Storage-related errors (%d occurrences) — check disk usage, clean up old logs/temp files, or expand storage",
    "frequent": 'High-frequency error pattern (%d occurrences): "%s" — investigate root cause urgently',
}

# What is advised about the start of an incident, one or several services, and severities.
START_ADVICE = "Incident started at {} — check infrastructure changes, deployments, or external events around that time"
SERVICES_ADVICE = ["{} is most affected — prioritize this service for investigation", "{} are most affected — prioritize these services for investigation"]
SEVERITY_ADVICE = {
    "CRITICAL": "CRITICAL severity — consider activating incident response procedures and notifying on-call teams",
    "HIGH": "HIGH severity — escalate to engineering leads and monitor for further degradation",
}

# Assessments of similar incidents.
ASSESSMENTS = {
    "HIGH": "HIGH SIMILARITY — These incidents are very likely related or caused by the same root issue. Consider investigating them as a single recurring problem.",
    "MODERATE": "MODERATE SIMILARITY — These incidents share some common patterns and may be partially related. Investigate shared error patterns for potential common root causes.",
    "LOW": "LOW SIMILARITY — These incidents have limited overlap. They are likely separate issues but may share some infrastructure dependencies.",
    "MINIMAL": "MINIMAL SIMILARITY — These incidents appear to be unrelated. Investigate them independently.",
}

# What is advised about faults of a table: the column, the count, and more on each.
QUALITY_ADVICE = {
    "missing": "Column '{}' has {} missing values ({}%). Consider imputation or removal.",
    "duplicate_rows": "Dataset contains {} exact duplicate rows. Consider deduplication.",
    "duplicate_ids": "Column '{}' has {} duplicate values. ID columns should be unique.",
    "emails": "Column '{}' contains {} invalid email addresses. Validate and correct email formats.",
    "dates": "Column '{}' contains {} invalid or unparseable dates. Standardise date formats.",
    "numbers": "Column '{}' contains {} non-numeric values in a numeric context. Clean or convert these values.",
    "outliers": "Column '{}' has {} outliers (values outside IQR range [{}, {}]). Review for data entry errors.",
    "suspicious": "Column '{}' is suspicious: {}. Consider dropping or investigating.",
}
