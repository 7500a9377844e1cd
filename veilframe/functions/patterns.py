r"""Detector patterns, as Java regular expressions for Spark and RE2 ones for SQL.

\b means the ASCII word boundary; Java's own one knows all letters, so it is spelt out (B). Look-
behinds have bounded gaps (up to 8 spaces between a label and its value).
"""

from __future__ import annotations

from dataclasses import dataclass

B = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
_S = r"\s{0,8}"


@dataclass(frozen=True)
class Pattern:
    """A detector: its id, type, Java pattern, RE2 pattern (and the group with the value)."""

    id: str
    type: str
    java: str
    re2: str
    group: int = 0
    #: Lower-case text that every match holds, so that texts without it are not scanned.
    hint: str = ""
    confidence: float = 0.0
    #: A faster pattern that matches wherever the Java one does, to leave texts early.
    first: str = ""

    @property
    def regex(self) -> str:
        return self.java.replace(r"\b", B)

    @property
    def quick(self) -> str:
        return self.first or self.regex


def _lab(id_: str, type_: str, label: str, sep: str, value: str, hint: str, fold: bool = True, end: str = r"\b") -> Pattern:
    """A value behind a label that stays outside of the span."""
    i = "(?i)" if fold else ""
    bounded = label.replace(r"\s*", _S).replace(r"\s+", r"\s{1,8}")
    return Pattern(id_, type_, rf"{i}(?<=\b(?:{bounded}){_S}{sep}{_S}){value}{end}", rf"{i}\b(?:{label})\s*{sep}\s*({value}){end}", 0, hint, first=rf"{i}(?<![A-Za-z0-9_])(?:{bounded}){_S}{sep}{_S}{value}")


# The thirty detectors, in the order that breaks ties of overlapping matches.
TIER0 = (
    Pattern("P1", "EMAIL_ID", r"(?i)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", r"(?i)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", hint="@"),
    Pattern("P2", "UPI_VPA", r"\b[a-zA-Z0-9._-]{2,}@[a-zA-Z][a-zA-Z0-9-]*(?!\.[a-zA-Z]{2,})\b", "", hint="@"),
    Pattern("P3", "PHONE_NUMBER", r"(?<![0-9])(?:\+91[\s.-]?)?[6-9][0-9]{9}(?![0-9])", ""),
    Pattern("P4", "DATE_OF_BIRTH", r"(?i)\b(?:DOB|D\.O\.B|Date of Birth|Birth Date)\s*[:\-]?\s*[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}\b", r"(?i)\b(?:DOB|D\.O\.B|Date of Birth|Birth Date)\s*[:\-]?\s*[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}\b"),
    Pattern("P5", "AGE", r"(?i)\b(?:age)\s*[:\-]?\s*[0-9]{1,3}\s*(?:years?|yrs?)?\b", r"(?i)\b(?:age)\s*[:\-]?\s*[0-9]{1,3}\s*(?:years?|yrs?)?\b", hint="age"),
    Pattern("P6", "AADHAAR", r"(?<![0-9])(?:[0-9]{4}[\s-]?){2}[0-9]{4}(?![0-9])", ""),
    Pattern("P7", "PAN_NUMBER", r"(?i)\b[A-Z]{5}[0-9]{4}[A-Z]\b", r"(?i)\b[A-Z]{5}[0-9]{4}[A-Z]\b"),
    Pattern("P8", "PASSPORT_NUMBER", r"(?i)\b[A-Z][0-9]{7}\b", r"(?i)\b[A-Z][0-9]{7}\b"),
    Pattern("P9", "VOTER_ID", r"(?i)\b[A-Z]{3}[0-9]{7}\b", r"(?i)\b[A-Z]{3}[0-9]{7}\b"),
    Pattern("P10", "DRIVING_LICENSE", r"(?i)\b[A-Z]{2}[-\s]?[0-9]{2}[-\s]?[0-9]{4}[-\s]?[0-9]{7}\b", r"(?i)\b[A-Z]{2}[-\s]?[0-9]{2}[-\s]?[0-9]{4}[-\s]?[0-9]{7}\b"),
    Pattern("P11", "CARD_NUMBER", r"(?<![0-9])(?:[0-9][ -]?){13,19}(?![0-9])", ""),
    _lab("P12", "BANK_ACCOUNT", r"(?:account|a/c|acct)\s*(?:number|no\.?)?", r"[:\-]?", r"[0-9]{9,18}", ""),
    Pattern("P13", "IBAN", r"(?i)\b[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\b", r"(?i)\b[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\b"),
    Pattern("P14", "IFSC_CODE", r"(?i)\b[A-Z]{4}0[A-Z0-9]{6}\b", r"(?i)\b[A-Z]{4}0[A-Z0-9]{6}\b"),
    Pattern("P15", "SWIFT_BIC", r"\b[A-Z]{4}[A-Z]{2}[A-Z0-9]{2}(?:[A-Z0-9]{3})?\b", r"\b[A-Z]{4}[A-Z]{2}[A-Z0-9]{2}(?:[A-Z0-9]{3})?\b"),
    Pattern("P16", "GSTIN", r"(?i)\b[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][0-9][Zz][A-Z0-9]\b", r"(?i)\b[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][0-9][Zz][A-Z0-9]\b"),
    _lab("P17", "TAX_ID", r"tax\s*(?:id|number)|TIN", r"[:\-]?", r"[A-Z0-9-]{6,20}", ""),
    Pattern("P18", "IP_ADDRESS", r"\b(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\b", r"\b(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\b"),
    Pattern("P19", "MAC_ADDRESS", r"\b(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}\b", r"\b(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}\b"),
    _lab("P20", "DEVICE_ID", r"device\s*id|device\s*identifier", r"[:\-]?", r"[A-Za-z0-9._:-]{6,50}", "device"),
    _lab("P21", "USERNAME", r"username|user\s*name|login\s*id", r"[:\-]?", r"[A-Za-z0-9._-]{3,40}", ""),
    _lab("P22", "PASSWORD", r"password|passwd|pwd", r"[:=]", r"\S+", "", end=""),
    _lab("P23", "PIN", r"PIN|pin\s*number", r"[:\-]?", r"[0-9]{4,6}", "", fold=False),
    _lab("P24", "OTP", r"OTP|one[-\s]?time\s+password", r"[:\-]?", r"[0-9]{4,8}", ""),
    Pattern("P25", "API_KEY", r"(?i)\b(?:api[_\s-]?key|apikey)\s*[:=]\s*[A-Za-z0-9_-]{12,}\b", r"(?i)\b(?:api[_\s-]?key|apikey)\s*[:=]\s*[A-Za-z0-9_-]{12,}\b", hint="api"),
    _lab("P26", "EMPLOYEE_ID", r"employee\s*(?:id|number|no\.?)", r"[:\-]?", r"[A-Za-z0-9-]{4,30}", "employee"),
    _lab("P27", "CUSTOMER_ID", r"customer\s*(?:id|number|no\.?)", r"[:\-]?", r"[A-Za-z0-9-]{4,30}", "customer"),
    Pattern("P28", "STUDENT_ID", r"(?i)\b(?:student\s*(?:id|number|no\.?))\s*[:\-]?\s*[A-Za-z0-9-]{4,30}\b", r"(?i)\b(?:student\s*(?:id|number|no\.?))\s*[:\-]?\s*[A-Za-z0-9-]{4,30}\b", hint="student"),
    Pattern("P29", "PATIENT_ID", r"(?i)\b(?:patient\s*(?:id|number|no\.?))\s*[:\-]?\s*[A-Za-z0-9-]{4,30}\b", r"(?i)\b(?:patient\s*(?:id|number|no\.?))\s*[:\-]?\s*[A-Za-z0-9-]{4,30}\b", hint="patient"),
    Pattern("P30", "POLICY_NUMBER", r"(?i)\b(?:policy\s*(?:number|no\.?|id))\s*[:\-]?\s*[A-Za-z0-9-]{5,30}\b", r"(?i)\b(?:policy\s*(?:number|no\.?|id))\s*[:\-]?\s*[A-Za-z0-9-]{5,30}\b", hint="policy"),
)

_SPOKEN = r"(?i)\b[a-z0-9._-]+(?:\s+dot\s+[a-z0-9._-]+)+\s+at\s+[a-z0-9-]+(?:\s+dot\s+[a-z0-9-]+)*\b"
_CREDENTIAL = r"(?i)\b(?=[A-Za-z0-9._-]*@)(?=[A-Za-z0-9._-]*[A-Za-z])[A-Za-z0-9._-]+@[A-Za-z0-9.-]+\b"

# Spans beside the detectors in page text.
EXTRA = (
    Pattern("P32", "EMAIL_ID", _SPOKEN, _SPOKEN, hint="dot", confidence=0.85),
    Pattern("P33", "PASSWORD", _CREDENTIAL, r"(?i)\b[A-Za-z0-9._-]*[A-Za-z][A-Za-z0-9._-]*@[A-Za-z0-9.-]+\b", hint="@", confidence=0.85),
)

# Formats that need no label.
UNLABELED = (
    Pattern("P34", "EMAIL", r"(?i)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,8}(?!\.[A-Za-z])\b", "", hint="@", confidence=0.95),
    Pattern("P35", "PHONE", r"(?<![0-9])(?:\+?1[\s.\-]?)?(?:\(?[2-9][0-9]{2}\)?[\s.\-]?)[0-9]{3}[\s.\-][0-9]{4}(?![0-9])", "", confidence=0.9),
    Pattern("P35", "PHONE", r"(?<![0-9])\+[0-9][0-9\s.\-()]{7,16}(?![0-9])", "", hint="+", confidence=0.9),
    Pattern("P36", "DATE", r"(?<![0-9])(0?[1-9]|1[0-2])/(0?[1-9]|[12][0-9]|3[01])/([0-9]{2}|[0-9]{4})(?![0-9])", "", hint="/", confidence=0.85),
    Pattern("P36", "DATE", r"(?<![0-9])(0?[1-9]|[12][0-9]|3[01])-(0?[1-9]|1[0-2])-([0-9]{2}|[0-9]{4})(?![0-9])", "", hint="-", confidence=0.85),
    Pattern("P36", "DATE", r"(?<![0-9])([0-9]{4})-(0?[1-9]|1[0-2])-(0?[1-9]|[12][0-9]|3[01])(?![0-9])", "", hint="-", confidence=0.85),
    Pattern("P37", "CARD_NUMBER", r"(?i)(?<![a-z])(?:ending|ends?)(?:\s+in)?[^0-9]{0,10}([0-9]{4})(?![0-9])", "", 1, hint="end", confidence=0.9),
    Pattern("P38", "EMAIL", _SPOKEN, _SPOKEN, hint="dot", confidence=0.85),
    Pattern("P39", "PASSWORD", _CREDENTIAL, "", hint="@", confidence=0.85),
    Pattern("P40", "IFSC", r"(?i)\b[A-Z]{4}0[A-Z0-9]{6}\b", r"(?i)\b[A-Z]{4}0[A-Z0-9]{6}\b", confidence=0.95),
    Pattern("P40", "IFSC", r"\b[A-Z](?:\s*[A-Z]){3}\s*0(?:\s*[A-Za-z0-9]){6}\b", "", confidence=0.95),
    Pattern("P41", "TRACKING_NUMBER", r"(?i)\b1Z(?:\s?[A-Z0-9]){16}\b", r"(?i)\b1Z(?:\s?[A-Z0-9]){16}\b", hint="1z", confidence=0.9),
    Pattern("P41", "TRACKING_NUMBER", r"(?<![0-9])[0-9]{12}(?![0-9])", "", confidence=0.9),
    Pattern("P41", "TRACKING_NUMBER", r"(?<![0-9])[0-9]{15}(?![0-9])", "", confidence=0.9),
    Pattern("P41", "TRACKING_NUMBER", r"(?<![0-9])[0-9]{20,22}(?![0-9])", "", confidence=0.9),
    Pattern("P42", "VAT_ID", r"(?i)\bGB\s?[0-9]{3}\s?[0-9]{4}\s?[0-9]{2}\b", r"(?i)\bGB\s?[0-9]{3}\s?[0-9]{4}\s?[0-9]{2}\b", hint="gb", confidence=0.85),
    Pattern("P42", "VAT_ID", r"(?i)\b(?:DE|FR|IT|ES|NL|BE|IE|AT|DK|SE|FI|PT|GR|PL|CZ|HU)\s?[0-9][A-Z0-9]{7,11}\b", r"(?i)\b(?:DE|FR|IT|ES|NL|BE|IE|AT|DK|SE|FI|PT|GR|PL|CZ|HU)\s?[0-9][A-Z0-9]{7,11}\b", confidence=0.85),
)

# Types of model findings, each with the placeholder <TYPE>.
MODEL_TYPES = (
    "ACCOUNT_NUMBER", "AGE", "API_KEY", "BANK_ROUTING_NUMBER", "BIOMETRIC_IDENTIFIER", "BLOOD_TYPE", "CERTIFICATE_LICENSE_NUMBER", "CITY", "COMPANY_NAME", "COORDINATE", "COUNTRY",
    "COUNTY", "CREDIT_DEBIT_CARD", "CUSTOMER_ID", "CVV", "DATE", "DATE_OF_BIRTH", "DATE_TIME", "DEVICE_IDENTIFIER", "EDUCATION_LEVEL", "EMAIL", "EMPLOYEE_ID", "EMPLOYMENT_STATUS",
    "FAX_NUMBER", "FIRST_NAME", "GENDER", "HEALTH_PLAN_BENEFICIARY_NUMBER", "HTTP_COOKIE", "IPV4", "IPV6", "LANGUAGE", "LAST_NAME", "LICENSE_PLATE", "MAC_ADDRESS",
    "MEDICAL_RECORD_NUMBER", "NATIONAL_ID", "OCCUPATION", "PASSWORD", "PHONE_NUMBER", "PIN", "POLITICAL_VIEW", "POSTCODE", "RACE_ETHNICITY", "RELIGIOUS_BELIEF", "SEXUALITY", "SSN",
    "STATE", "STREET_ADDRESS", "SWIFT_BIC", "TAX_ID", "TIME", "UNIQUE_ID", "URL", "USER_NAME", "VEHICLE_IDENTIFIER",
)

# Types that are strong by their shape, and words that make a match likelier.
STRONG_TYPES = ("EMAIL_ID", "UPI_VPA", "PAN_NUMBER", "AADHAAR", "IFSC_CODE", "GSTIN", "MAC_ADDRESS", "API_KEY", "PASSWORD", "OTP")
CONTEXT_WORDS = (
    "email", "phone", "mobile", "address", "account", "password", "otp", "pin", "passport", "pan", "aadhaar", "bank", "card", "username", "login", "student", "employee", "patient",
    "dob", "birth", "ifsc", "upi", "vpa", "signup", "signin", "gst", "tax",
)

BY_ID = {p.id: p for p in TIER0}
