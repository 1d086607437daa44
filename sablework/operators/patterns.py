"""The detectors' patterns, in the dialect of policies, with confidences: fixed values.

``guard`` is a cheap necessary condition in Java's dialect on the whole text:
where it fails, the pattern can't match and isn't tried. ``group``: the capturing
group that is the find (0: the whole match); none of the patterns here has one.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Pattern:
    regex: str
    confidence: float
    guard: str = "[0-9]"
    group: int = 0

    @property
    def needs_digit(self) -> bool:
        """The guard can't hold in a text without ASCII digits."""
        return self.guard.startswith(("[0-9]", r"\+[0-9]", "1", "[13]", "bc1"))


@dataclass(frozen=True)
class Kind:
    """One detector of the fixed order; ``options`` picks other patterns when a switch is set."""

    key: str
    filter_type: str
    patterns: tuple[Pattern, ...]
    options: dict[str, tuple[Pattern, ...]] = field(default_factory=dict)


_OCTET = "(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"
_MONTH = (
    "(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
)
_HOST = r"[a-z\d]+([\-\.]{1}[a-z\d]+)*\.[a-z]{2,5}(:[0-9]{1,5})?(\/.*)?"
#: Letters that fold to ASCII ones count as such: U+212A and U+017F.
_LETTER = r"A-Za-z\x{212A}\x{017F}"
_DOT = rf"[0-9{_LETTER}]\.[{_LETTER}]{{2}}"

KINDS: tuple[Kind, ...] = (
    Kind("age", "age", (
        Pattern(r"(?i)\b[0-9.]+[\s]*(year|years|yrs|yr|yo)(.?)(\s)*(old)?\b", 0.90, r"[0-9.][\t\n\f\r ]*[yY][eErRoO]"),
        Pattern(r"(?i)\b(age)(d)?(\s)*[0-9.]+\b", 0.90, r"[aA][gG][eE][dD]?[\t\n\f\r ]*[0-9.]"),
        Pattern(r"(?i)\b[0-9.]+[-]*(year|years|yrs|yr|yo)[-. ]*(?:old)?\b", 0.90, "[0-9.]-*[yY][eErRoO]"),
        Pattern(r"(?i)\b([0-9]{1,3}) (y\/o)\b", 0.90, "[yY]/[oO]"),
    )),
    Kind("bankRoutingNumber", "bank-routing-number", (Pattern(r"\b[0123679]\d{8}\b", 0.75, "[0-9]{9}"),)),
    Kind("bitcoinAddress", "bitcoin-address", (
        Pattern(r"\b[13][a-km-zA-HJ-NP-Z1-9]{25,34}\b", 0.90, "[13][a-km-zA-HJ-NP-Z1-9]{25}"),
        Pattern(r"\bbc1[ac-hj-np-z02-9]{6,87}\b", 0.90, "bc1"),
    )),
    Kind("creditCard", "credit-card", (
        Pattern(r"\b4[0-9]{12}(?:[0-9]{3})?\b", 0.90, "[0-9]{13}"),
        Pattern(r"\b(?:5[1-5][0-9]{2}|222[1-9]|22[3-9][0-9]|2[3-6][0-9]{2}|27[01][0-9]|2720)[0-9]{12}\b", 0.90, "[0-9]{16}"),
        Pattern(r"\b3[47][0-9]{13}\b", 0.90, "[0-9]{15}"),
        Pattern(r"\b3(?:0[0-5]|[68][0-9])[0-9]{11}\b", 0.90, "[0-9]{14}"),
        Pattern(r"\b6(?:011|5[0-9]{2})[0-9]{12}\b", 0.90, "[0-9]{16}"),
        Pattern(r"\b(?:2131|1800|35\d{3})\d{11}\b", 0.90, "[0-9]{15}"),
    )),
    Kind("date", "date", (
        Pattern(rf"(?i)\b{_MONTH}\s+\d{{1,2}},?\s+\d{{4}}\b", 0.90, "[0-9]{4}"),
        Pattern(r"\b(?:0?[1-9]|1[0-2])[/\-.](?:0?[1-9]|[12][0-9]|3[01])[/\-.](?:19|20)\d{2}\b", 0.80, "[0-9]{4}"),
        Pattern(r"\b(?:19|20)\d{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])\b", 0.90, "[0-9]{4}-"),
        Pattern(rf"(?i)\b\d{{1,2}}\s+{_MONTH}\s+\d{{4}}\b", 0.85, "[0-9]{4}"),
    )),
    Kind("driversLicense", "drivers-license-number", (
        Pattern(r"(?i)\b[a-z]\d{7}\b", 0.70, "[0-9]{7}"),
        Pattern(r"\b\d{7,9}\b", 0.50, "[0-9]{7}"),
        Pattern(r"(?i)\b[a-z]{1,2}\d{5,7}\b", 0.70, "[0-9]{5}"),
    )),
    Kind("emailAddress", "email-address", (Pattern(r"(?i)\b[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}\b", 0.90, "@"),)),
    Kind("ibanCode", "iban-code", (Pattern(r"(?i)\b[A-Z]{2}[0-9]{2}[A-Z0-9]{1,30}\b", 0.85, "[0-9]{2}"),)),
    Kind("ipAddress", "ip-address", (
        Pattern(rf"\b(?:{_OCTET}\.){{3}}{_OCTET}\b", 0.90, r"[0-9]\.[0-9]"),
        Pattern(r"(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}", 0.90, ":"),
        Pattern(r"(?:[0-9a-fA-F]{1,4}:)*::(?:[0-9a-fA-F]{1,4}:)*[0-9a-fA-F]{0,4}", 0.90, "::"),
    )),
    Kind("macAddress", "mac-address", (
        Pattern(r"(?i)\b(?:[0-9a-f]{2}[:\-]){5}[0-9a-f]{2}\b", 0.90, "[0-9a-fA-F]{2}[:-]"),
        Pattern(r"(?i)\b(?:[0-9a-f]{4}\.){2}[0-9a-f]{4}\b", 0.90, r"[0-9a-fA-F]{4}\.[0-9a-fA-F]{4}"),
    )),
    Kind("passportNumber", "passport-number", (Pattern(r"(?i)\b[A-Z][0-9]{8}\b", 0.75, "[0-9]{8}"),)),
    Kind("phoneNumber", "phone-number", (
        Pattern(r"(?:(?:\+?1[-. ]?)?\(?\d{3}\)?[-. ]?\d{3}[-. ]?\d{4})", 0.90, "[0-9]{4}"),
        Pattern(r"\+\d{1,3}[-. ]?\(?\d{1,4}\)?[-. ]?\d{1,4}[-. ]?\d{1,9}", 0.85, r"\+[0-9]"),
    )),
    Kind("ssn", "ssn", (
        Pattern(r"\b[0-9]{3}[- ]?[0-9]{2}[- ]?[0-9]{4}\b", 0.90, "[0-9]{4}"),
        Pattern(r"\b[0-9]{2}-[0-9]{7}\b", 0.90, "[0-9]{7}"),
    )),
    Kind("trackingNumber", "tracking-number", (
        Pattern(r"(?i)\b1Z[A-Z0-9]{16}\b", 0.90, "1[zZ]"),
        Pattern(r"\b(?:\d{12}|\d{15}|\d{20})\b", 0.70, "[0-9]{12}"),
        Pattern(r"\b\d{20,22}\b", 0.75, "[0-9]{20}"),
        Pattern(r"(?i)\b[A-Z]{2}\d{8}US\b", 0.90, "[0-9]{8}"),
    )),
    Kind("url", "url", (Pattern(rf"(?i)(http://www\.|https://www\.|http://|https://)?{_HOST}", 0.10, _DOT),), {
        "requireHttpWwwPrefix": (Pattern(rf"(?i)(www\.|http://www\.|https://www\.|http://|https://){_HOST}", 0.80, r"://|[wW]\."),),
    }),
    Kind("vin", "vin", (Pattern(r"(?i)\b[A-HJ-NPR-Z0-9]{17}\b", 0.90, rf"[0-9{_LETTER}]{{17}}"),)),
    Kind("zipCode", "zip-code", (Pattern(r"\b[0-9]{5}(?:-?[0-9]{4})?\b", 0.50, "[0-9]{5}"),), {
        "requireDelimiter": (Pattern(r"\b[0-9]{5}(?:-[0-9]{4})?\b", 0.90, "[0-9]{5}"),),
    }),
)

# Fixed value: the strict form of e-mail addresses; no policy asks for it, only callers of the detector can.
STRICT_EMAIL = Pattern(
    r'''(?i)\b(?:[a-z\d!#$%&'*+/=?^_`{|}~-]+(?:\.[a-z\d!#$%&'*+/=?^_`{|}~-]+)*|"(?:[\x01-\x08\x0b\x0c\x0e-\x1f\x21\x23-\x5b\x5d-\x7f]|\\[\x01-\x09\x0b\x0c\x0e-\x7f])*")@(?:(?:[a-z\d](?:[a-z\d-]*[a-z\d])?\.)+[a-z\d](?:[a-z\d-]*[a-z\d])?|\[(?:(?:25[0-5]|2[0-4][\d]|[01]?[\d][\d]?)\.){3}(?:25[0-5]|2[0-4][\d]|[01]?[\d][\d]?|[a-z\d-]*[a-z\d]:(?:[\x01-\x08\x0b\x0c\x0e-\x1f\x21-\x5a\x53-\x7f]|\\[\x01-\x09\x0b\x0c\x0e-\x7f])+)\])\b''',
    0.90,
    "@",
)

#: All values of a span's filter_type; only those above, custom-dictionary and pheye are ever produced.
FILTER_TYPES = tuple(k.filter_type for k in KINDS) + (
    "custom-dictionary", "pheye", "currency", "id", "phone-number-extension", "street-address", "city", "county", "state",
    "state-abbreviation", "first-name", "surname", "hospital", "person", "medical-condition",
)
