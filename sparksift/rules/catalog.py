"""The built-in rule catalogue: identifiers, payment data, credentials, labels.

Expressions are composed from small parts and written in RE2 syntax; spaces in
labels stand for any run of white space. The organisation's own domains are a
parameter (see OrgProfile).
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from .model import Catalog, Compound, Pattern, Rule

B = r"\b"


@dataclass(frozen=True)
class OrgProfile:
    """What is specific to the organisation that scans: its name, domains, and the domains whose addresses never exceed INTERNAL."""

    name: str = "acme"
    domains: tuple[str, ...] = ("acme.example", "it.acme.example", "labs.acme.example", "acme-net.example", "acme-media.example")
    extra_mail_domains: tuple[str, ...] = ("acme.com.example",)
    capped: tuple[str, ...] = ("acme.example", "it.acme.example", "labs.acme.example")


def alt(items: Iterable[str]) -> str:
    """Alternatives, longest first."""
    return "(?:" + "|".join(sorted(items, key=lambda x: (-len(x), x))) + ")"


def label(text: str) -> str:
    """A label or labels separated by `;`, with any white space for a space, in any case."""
    return alt(w.strip().replace(" ", r"\s*") for w in text.split(";"))


def words(text: str) -> tuple[str, ...]:
    return tuple(w.strip() for w in text.split(";") if w.strip())


def digits(n: int | str) -> str:
    return r"\d{%s}" % n


def grouped(*sizes: int) -> str:
    """Groups of digits with an optional dash or space before each."""
    return "".join(rf"[-\s]?{digits(n)}" for n in sizes)


def year(low: str) -> str:
    return low + r"\d{2}"


D4, D8, D9, D10, D12, D13 = (rf"[0-9]{{{n}}}" for n in (4, 8, 9, 10, 12, 13))
CARD_GATE = r"[0-9]{4}[-\t\n\f\r ]?[0-9]{4,6}[-\t\n\f\r ]?[0-9]{4,5}"
LETTERS = "A-Za-z"
ALNUM = LETTERS + "0-9"
MAIL_LOCAL = f"[{ALNUM}" + "._%+" + r"\-" + "]+@"
MAIL_HOST = f"[{ALNUM}" + r".\-" + "]+" + r"\."
FEW = "[1-9]"
DAYS, MONTHS = ("[12]\\d", "3[01]"), ("1[0-2]",)
DAY, MONTH = ("(?:" + "|".join(("0?" + FEW, *x)) + ")" for x in (DAYS, MONTHS))
DAY2, MONTH2 = ("(?:" + "|".join(("0" + FEW, *x)) + ")" for x in (DAYS, MONTHS))
DATE_SEP = "[-/.]"
OCTET = "(?:" + "|".join(["25[0-5]", r"2[0-4]\d", r"1\d{2}", r"[1-9]\d", r"\d"]) + ")"
MOBILE = "(?:" + "|".join([*(k + "[2-9]" for k in "35"), "7(?:0|[6-9])", "[89]\\d"]) + ")" + digits(7)
AMOUNT = r"[\d.,]+"
SURNAMES = "Bùi Dương Hoàng Huỳnh Hồ Lê Lý Nguyễn Ngô Phan Phạm Trần Trịnh Võ Vũ Đinh Đoàn Đặng Đỗ".split()
MORE_SURNAMES = SURNAMES + "Cao Châu Hà Kiều La Linh Lâm Lưu Lương Mai Mạc Nghiêm Ngọc Quách Thiều Thái Thị Tiền Trương Tô Tăng Tống Văn Vương Đào".split()
NAME_WORD = r"\p{Lu}\p{L}+"
DASH = "[:=—\\-]"


def upper(n: int | str) -> str:
    return "[A-Z]{%s}" % n


def code(n: int | str) -> str:
    return "[A-Z0-9]{%s}" % n


BRANCH = "(?:" + code(3) + ")?"
#: Labels of security codes and expiry dates near a card.
CARD_CODE = "(?i)(?:" + "|".join(("cvc", "cvv", r"security\s*code")) + ")" + r"\D{0,5}" + "(" + digits("3,4") + ")" + B
CARD_EXPIRY = B + MONTH2 + "[-/]" + "(?:" + "|".join((digits(4), digits(2))) + ")" + B


def card(prefix: str, *groups: int, tail: str = "") -> str:
    return B + prefix + grouped(*groups) + tail + B


def build(org: OrgProfile = OrgProfile()) -> Catalog:
    own = alt(d.replace(".", r"\.") for d in org.domains)
    own_mail = alt(d.replace(".", r"\.") for d in (*org.domains, *org.extra_mail_domains))
    name = org.name
    cards = lambda regex, c: Pattern(regex, c, validators=("luhn",), gate=CARD_GATE)
    near = lambda regex, c, **k: Pattern(regex, c, needs_context=True, **k)
    free = lambda regex, c, *anchors, **k: Pattern("(?i)" + regex, c, anchors=anchors, **k)

    master = "(?:5[1-5]" + digits(2) + "|2(?:2(?:2[1-9]|[3-9]\\d)|[3-6]" + digits(2) + "|7(?:[01]\\d|20)))"
    discover = "(?:6011|64[4-9]\\d|65" + digits(2) + "|622(?:1(?:2[6-9]|[3-9]\\d)|[2-8]" + digits(2) + "|9(?:[01]\\d|2[0-5])))"
    rules = [
        Rule(
            "credit_card_001", "Payment cards", "financial", "SECRET", 0.95, 100,
            (
                cards(card("4" + digits(3), 4, 4, 4), 0.95), cards(card(master, 4, 4, 4), 0.95), cards(card("3[47]" + digits(2), 6, 5), 0.95),
                cards(card("35(?:2[89]|[3-8]\\d)\\d", 4, 4, 4), 0.90), cards(card(discover, 4, 4, 4), 0.90), cards(card("9704" + digits(2), 4, 4, 4), 0.92),
                cards(card("(?:62[4-6]\\d|628\\d)", 4, 4, 4, tail="(?:" + grouped(3) + ")?"), 0.88),
            ),
            words("card number; credit card; debit card; PAN; số thẻ; thẻ ghi nợ; thẻ tín dụng"),
            words("Amex; cardholder; chủ thẻ; CVC; CVV; expiry; JCB; Mastercard; Napas; ngày hết hạn; valid thru; Visa"),
            card_boost=0.07,
        ),
        Rule(
            "cvv_001", "Card security codes", "financial", "SECRET", 0.95, 98,
            (
                free("(?:cv[vc]2?|" + r"card\s*" + label("security code; verification") + "|csc)" + r"\s*[-=:]?\s*" + digits("3,4") + B, 0.97, "cv", "csc", "card"),
                free(r"(?:[id]cvv|dynamic\s*cvv)\s*[-=:]?\s*\d{3,4}\b", 0.95, "cvv"),
                near(B + digits("3,4") + B, 0.30),
            ),
            words("card security code; CSC; CVC; CVC2; CVV; CVV2; mã bảo mật; security code"),
            words("3-digit; 4-digit; card verification; CID; credit card; debit card; thẻ ghi nợ; thẻ tín dụng"),
        ),
        Rule(
            "bank_account_001", "Bank accounts", "financial", "CONFIDENTIAL", 0.88, 70,
            (
                near(rf"\b({digits('9,14')})\b", 0.70, validators=("vn_bank_prefix",), gate=D9), near(rf"\b({digits('15,16')})\b", 0.85, validators=("vn_bank_prefix",), gate=D13),
                near(rf"\b{digits(4)}[-\s]{digits(4)}[-\s]{digits('4,6')}\b", 0.75, validators=("vn_bank_prefix",), gate=D4),
                near(B + alt(["0400", "0600", "1970", "2002", "4200", "7901", "9704", "9999"]) + digits("6,10") + B, 0.80, gate=D10),
            ),
            words("account number; bank account; chuyển khoản; số tài khoản; số TK; STK; tài khoản; tài khoản ngân hàng"),
            words("ABBANK; ACB; Agribank; Bac A Bank; beneficiary; BIDV; chủ tài khoản; CIF; CTK; Eximbank; HDBank; Kienlongbank; LienVietPostBank; MB Bank; MSB; mã CIF; Nam A Bank; ngân hàng; người thụ hưởng; nộp tiền; OCB; PGBank; routing; rút tiền; Sacombank; SeABank; SHB; số dư; swift; Techcombank; TPBank; tài khoản thanh toán; tài khoản tiết kiệm; VIB; Vietcombank; Vietinbank; VPBank"),
            exclude_if_no_keywords=True,
            escalation=words("account statement; balance; giao dịch gần đây; lịch sử giao dịch; lịch sử tài khoản; sao kê; statement; số dư"), escalate_to="SECRET",
        ),
        Rule(
            "tax_code_business_001", "Tax codes of companies", "financial", "INTERNAL", 0.75, 60,
            (Pattern(rf"\b{digits(10)}-{digits(3)}\b", 0.92, gate=D10 + "-"), near(r"\b(?:0[1-9]|9[0-6]|[1-8]\d)" + digits(8) + B, 0.78, gate=D10), near(B + digits(10) + B, 0.65, gate=D10)),
            words("business registration number; MSDN; MST; mã doanh nghiệp; mã số doanh nghiệp; mã số kinh doanh; mã số thuế; tax code; Tax ID; tax identification; Tax No; TIN; đăng ký kinh doanh"),
            words("chi cục thuế; cục thuế; giấy chứng nhận đăng ký; giấy phép kinh doanh; GTGT; hoàn thuế; hóa đơn; kê khai thuế; quyết toán thuế; thuế thu nhập doanh nghiệp; TNDN; VAT"),
            exclude_if_no_keywords=True,
        ),
        Rule(
            "tax_code_personal_001", "Tax codes of persons", "financial", "CONFIDENTIAL", 0.85, 62,
            (near(B + digits(13) + B, 0.78, gate=D13), free(label("mã số thuế cá nhân; MST cá nhân; TNCN số; mã số cá nhân") + r"\s*[=:]?\s*" + digits(13), 0.92, "cá", "tncn", gate=D13)),
            words("MST cá nhân; mã số cá nhân; mã số thuế cá nhân; personal income tax; personal tax; tax identification number; thuế thu nhập cá nhân; TIN cá nhân; TNCN"),
            words("cục thuế; hoàn thuế TNCN; khấu trừ thuế; kê khai thuế; phiếu lương; quyết toán thuế; thu nhập chịu thuế"),
            exclude_if_no_keywords=True,
        ),
        Rule(
            "swift_bic_001", "Bank identifier codes", "financial", "INTERNAL", 0.87, 65,
            (Pattern(B + upper(4) + "VN" + code(2) + BRANCH + B, 0.92, gate="[A-Z]{4}VN"), near(B + upper(6) + code(2) + BRANCH + B, 0.75, gate="[A-Z]{6}")),
            words("bank identifier; BIC; BIC code; mã swift; SWIFT; SWIFT code; swift/bic"),
            words("Agribank; bank code; BIDV; chuyển tiền quốc tế; correspondent bank; international transfer; ngân hàng đại lý; routing code; Vietcombank; VietinBank; wire transfer"),
            exclude_if_no_keywords=True,
        ),
        Rule(
            "iban_001", "IBAN", "financial", "CONFIDENTIAL", 0.87, 58,
            (near(B + upper(2) + digits(2) + code(4) + digits(7) + code("0,16") + B, 0.85, gate="[A-Z]{2}[0-9]{2}[A-Z0-9]{4}"), near(B + upper(2) + digits(2) + "(?:" + r"\s" + code(4) + "){2,7}" + B, 0.88, gate=r"[A-Z]{2}[0-9]{2}[\t\n\f\r ]")),
            words("account number; BBAN; IBAN; international bank account"),
            words("BIC; chuyển tiền quốc tế; correspondent; EUR; foreign bank; GBP; international transfer; ngân hàng nước ngoài; swift; USD; wire transfer"),
            exclude_if_no_keywords=True,
        ),
        Rule(
            "income_001", "Income and pay", "financial", "CONFIDENTIAL", 0.82, 52,
            (
                free(label("lương; lương cơ bản; lương gross; lương net; lương năm; lương tháng; mức lương; thu nhập; thu nhập gộp; thu nhập ròng") + rf"\s*[=:]?\s*{AMOUNT}\s*(?:nghìn|triệu|đồng|vnđ|VND|tr\.?|k\b)?", 0.85, "lương", "thu"),
                free(label("bonus; commission; hoa hồng; mức thưởng; thù lao; thưởng KPI") + rf"\s*[=:]?\s*{AMOUNT}\s*(?:triệu|đồng|vnđ|VND|tr\.?|%)?", 0.82, "bonus", "commission", "hoa", "thưởng", "thù"),
                free(label("annual salary; compensation; income; monthly salary; pay rate; remuneration; salary; wage") + rf"\s*[=:]?\s*(?:EUR|GBP|USD|VND)?\s*{AMOUNT}", 0.82, "salary", "income", "wage", "compensation", "remuneration", "pay"),
                free(label("income; lương; salary") + B + ".*?" + "(" + digits("1,3") + "(?:[,.]" + digits(3) + ")+)", 0.72, "income", "lương", "salary", needs_context=True, gate=r"[0-9][.,][0-9]{3}"),
            ),
            words("bảng lương; income; lương; lương gross; lương net; mức lương; payroll; salary; thu nhập; thù lao; thưởng"),
            words("BHXH; bonus; bảo hiểm xã hội; commission; employment contract; hoa hồng; HR; hợp đồng lao động; KPI; nhân sự; pay slip; payslip; personal income tax; phiếu lương; phòng nhân sự; thuế thu nhập cá nhân; thưởng doanh số; TNCN"),
        ),
        Rule(
            "credentials_001", "Credentials and keys", "org", "SECRET", 0.95, 97,
            (
                free(r"(?:api[_-]?key|secret(?:[_-]?key)?|access[_-]?(?:key|token)|auth[_-]?token|token)[\"']?\s*[=:]\s*[\"']?[A-Za-z0-9_\-./+=${}*]{8,}", 0.92, "key", "secret", "token"),
                free(r"(?:password|passwd|pwd|mật\s*khẩu)[\"']?\s*[=:]\s*[\"']?[^\s\"']{4,}", 0.90, "pass", "pwd", "mật"),
                Pattern(r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b", 0.97, gate="A[KS]IA"),
                Pattern(r"\b(?:gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,})", 0.97, gate="gh[pousr]_|xox[abprs]-|sk_live_"),
                Pattern(r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0.95, gate="eyJ"),
                Pattern(r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----", 0.99, gate="-----BEGIN"),
                free(r"\b(?:jdbc:)?(?:postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqp)://[^\s:/@]+:[^\s@]+@[^\s\"']+", 0.95, "://"),
            ),
            words("access token; api key; api_key; credential; mật khẩu; password; private key; secret; token"),
            words("auth; bearer; connection string; database; env; login; username; đăng nhập"),
        ),
        Rule(
            "classified_doc_001", "Top-secret labels", "org", "SECRET", 0.95, 95,
            (
                free(B + label("cực kỳ bí mật; top secret; tối mật") + B, 0.97, "mật", "secret", override="SECRET"),
                free(label("classification; label; phân loại; security label") + rf"\s*{DASH}\s*(?:restricted|mật)\b", 0.96, "restricted", "mật", override="SECRET"),
                free(r"\brestricted\b", 0.82, "restricted", needs_context=True, override="SECRET"),
            ),
            words("bí mật nhà nước; cực mật; eyes only; highly sensitive; MẬT; need to know; RESTRICTED; strictly confidential; TOP SECRET; tuyệt mật; tài liệu mật; TỐI MẬT; đóng dấu mật"),
            words("access control; classification level; hạn chế tối đa; không được sao chép; kiểm soát đặc biệt; lưu hành hạn chế; nhạy cảm cao; phân loại tài liệu; security classification"),
        ),
        Rule(
            "classified_doc_002", "Secret and confidential labels", "org", "CONFIDENTIAL", 0.92, 94,
            (
                free(B + label("bí mật") + B, 0.95, "mật", override="CONFIDENTIAL"),
                free(label("classification; label; phân loại; security label") + rf"\s*{DASH}\s*confidential\b", 0.96, "confidential", override="CONFIDENTIAL"),
                free(r"\bconfidential\b", 0.78, "confidential", needs_context=True, override="CONFIDENTIAL"),
            ),
            words("BÍ MẬT; bí mật thương mại; company confidential; CONFIDENTIAL; nội dung bảo mật; private and confidential; proprietary; thông tin mật; thông tin độc quyền"),
            words("cam kết bảo mật; classification level; hợp đồng bảo mật; không được sao chép; lưu hành hạn chế; NDA; non-disclosure; phân loại tài liệu; security classification; thỏa thuận bảo mật"),
        ),
        Rule(
            "contract_001", "Contract numbers", "org", "CONFIDENTIAL", 0.78, 60,
            (Pattern(r"(?i)\b(?:contract|ctr|hd|hđ|po)[-/]?\s*" + digits("4,12") + r"(?:[-/][A-Z0-9]+)*\b", 0.90, gate=D4, anchors=("contract", "ctr", "hd", "hđ", "po")),),
            words("agreement; contract; hợp đồng; hợp đồng dịch vụ; hợp đồng mua bán; NDA; non-disclosure; thoả thuận bảo mật; thỏa thuận"),
            words("annex; appendix; breach; báo giá; bảo mật; bồi thường; cam kết; chấm dứt; conditions; confidential; effective date; hiệu lực; nghĩa vụ; obligation; penalty; phụ lục; purchase order; quotation; quyền và nghĩa vụ; termination; terms; vi phạm; điều khoản; đơn đặt hàng"),
            escalation=words("an ninh quốc gia; bí mật nhà nước; mật; quốc phòng; tối mật"), escalate_to="SECRET",
        ),
        Rule(
            "internal_ip_001", "Private IPv4 addresses", "org", "INTERNAL", 0.75, 50,
            (Pattern(B + "(?:" + "|".join([r"10(?:\." + OCTET + "){3}", r"172\." + alt(["1[6-9]", "2\\d", "3[01]"]) + "(?:\\." + OCTET + "){2}", r"192\.168(?:\." + OCTET + "){2}"]) + ")" + B, 0.88, gate=r"1[0-9]{1,2}\.[0-9]{1,3}\."),),
            words("firewall; gateway; IP address; router; server; subnet; địa chỉ IP"),
            words("database; DHCP; DNS; endpoint; host; internal network; LAN; mạng nội bộ; network diagram; server IP; sơ đồ mạng; topology; VPN; WAN"),
            escalation=words("admin; credentials; login; mật khẩu; passwd; password; rdp; root; ssh; telnet; username"), escalate_to="CONFIDENTIAL",
        ),
        Rule(
            "watermark_001", "Internal-use marks", "org", "INTERNAL", 0.80, 45,
            (
                free(label("chỉ lưu hành nội bộ; do not distribute; for internal use only; internal use only"), 0.93, "lưu", "distribute", "internal"),
                free(label("classification; label; phân loại") + rf"\s*{DASH}\s*(?:internal|nội\s*bộ)\b", 0.95, "internal", "nội"),
                free(r"nội\s*bộ\s*[-—–]\s*" + label("hạn chế lưu hành; hạn chế phát hành; hạn chế phổ biến; không phổ biến"), 0.92, "nội"),
                free(r"internal\s*[-—–]\s*" + label("hạn chế; không phổ biến; limited; restricted"), 0.92, "internal"),
                free(r"không\s*(?:phát\s*hành|phổ\s*biến)\s*ra\s*ngoài", 0.88, "ngoài"),
                free(r"\binternal\b", 0.72, "internal", needs_context=True),
            ),
            words("chỉ lưu hành nội bộ; do not distribute; hạn chế lưu hành; hạn chế phổ biến; internal; internal use only; không phổ biến; không phổ biến ra ngoài; lưu hành nội bộ; nội bộ"),
            words(f"bảo mật; circulation; hạn chế; phát hành; phân loại; tài liệu; {name}"),
        ),
        Rule(
            "org_email_001", "Addresses of the organisation", "org", "INTERNAL", 0.80, 42,
            (Pattern(B + MAIL_LOCAL + own + B, 0.95, anchors=("@",)),),
            tuple([name, "email nội bộ", *("@" + d for d in org.domains)]),
            words(f"cán bộ {name}; nhân viên {name}; nội bộ {name}; tập đoàn {name}"),
        ),
        Rule(
            "internal_code_001", "Internal codes", "org", "INTERNAL", 0.70, 40,
            (
                Pattern(rf"\b{name.upper()}-[A-Z]{{2,4}}-{digits('4,8')}\b", 0.95, gate=name.upper() + "-"), Pattern(r"\bPRJ-" + digits(6) + B, 0.90, gate="PRJ-"),
                Pattern(r"\b(?:MDV|MĐV|ORG)[_-]?" + digits("4,8") + B, 0.88, gate="(?:M[DĐ]V|ORG)[_-]?[0-9]"), near(r"\b(?:EMP|MSNV|NV)[_-]?" + digits("4,8") + B, 0.85, gate="(?:EMP|NV)[_-]?[0-9]"),
                Pattern(r"\b(?:CHG|INC|PRB|REQ|TKT)[#-]" + digits("6,10") + B, 0.87, gate="[A-Z][#-][0-9]{6}"),
            ),
            words(f"chỉ lưu hành nội bộ; for internal use only; internal; không phổ biến; mã dự án; nội bộ; project code; restricted; {name}"),
            words(f"change request; employee; hệ thống nội bộ; incident; internal only; nhân viên; nội bộ {name}; phòng ban; ticket; đơn vị"),
        ),
        Rule(
            "health_001", "Health data", "pii", "SECRET", 0.90, 85,
            (
                free(label("bệnh án; health record; hồ sơ bệnh án; medical record; patient record"), 0.88, "bệnh", "record"),
                free(label("chẩn đoán; diagnosis; kết luận khám; kết quả khám") + r"\s*[=:]", 0.90, "chẩn", "diagnosis", "kết"),
                free(label("kết quả xét nghiệm; lab result; laboratory; test result; xét nghiệm") + r"\s*[=:]", 0.88, "xét", "result", "laboratory"),
                free("(?:" + r"viêm\s*gan\s*[A-E]|" + label("AIDS; cancer; cardiovascular; chronic kidney; diabetes; hepatitis; HIV; lao phổi; malignant; psychiatric; renal failure; stroke; suy thận; thận mãn; tim mạch; tiểu đường; tuberculosis; tâm lý học; tâm thần; u ác tính; ung thư; đột quỵ") + ")", 0.82, needs_context=True),
                free(label("dosage; liều dùng; medication; prescription; thuốc điều trị; toa thuốc; đơn thuốc") + r"\s*[=:]", 0.85, "dosage", "liều", "medication", "prescription", "thuốc"),
                near(B + "[A-Z]" + digits(2) + "(?:" + r"\." + digits("1,4") + ")?" + B, 0.70, gate="[A-Z][0-9]{2}"),
            ),
            words("bệnh nhân; bệnh viện; bệnh án; chẩn đoán; clinic; diagnosis; health record; hospital; hồ sơ bệnh án; kết quả xét nghiệm; lab result; medical; medical history; patient; phòng khám; sức khỏe; tiền sử bệnh; y tế"),
            words("BHYT; bác sĩ; bảo hiểm y tế; doctor; ICD; khám bệnh; nhập viện; phẫu thuật; prescription; surgery; thuốc; treatment; xuất viện; xét nghiệm; điều trị; đơn thuốc"),
            exclude_if_no_keywords=True,
        ),
        Rule(
            "biometric_001", "Biometric data", "pii", "SECRET", 0.92, 83,
            (
                free("(?:" + r"biometric(?:\s*data)?|" + label("dấu vân tay; face id; face recognition; facial recognition; fingerprint; iris scan; nhận dạng giọng nói; nhận dạng khuôn mặt; retina; sinh trắc học; vân tay; voice print; võng mạc") + ")", 0.88, "biometric", "vân", "face", "facial", "fingerprint", "iris", "dạng", "retina", "trắc", "voice", "mạc"),
                free(r"(?:biometric|face|fingerprint)\s*" + alt(["data", "embedding", "feature", "hash", "template", "vector"]) + r"\s*[=:]\s*" + f"[{ALNUM}+/=]" + "{20,}", 0.95, "biometric", "face", "fingerprint"),
                free(label("chip data; contactless chip; dữ liệu chip; eMRTD; ePassport data; NFC data; thẻ chip"), 0.85, "chip", "emrtd", "epassport", "nfc"),
                free("(?:" + "anti-spoofing|" + label("face id; faceid; liveness detection; nhận dạng sinh trắc; touch id; touchid; windows hello") + ")", 0.82, "anti-spoofing", "face", "liveness", "trắc", "touch", "windows", needs_context=True),
            ),
            words("biometric; face recognition; FaceID; fingerprint; giọng nói; iris; khuôn mặt; mống mắt; nhận dạng khuôn mặt; nhận dạng sinh trắc; sinh trắc học; TouchID; voice recognition; vân tay"),
            words("anti-spoofing; authentication; chip CCCD; chống giả mạo; embedding; ePassport; liveness; template; xác thực; định danh sinh trắc"),
        ),
        Rule(
            "vn_id_001", "Citizen identity numbers", "pii", "CONFIDENTIAL", 0.90, 80,
            (near(rf"\b({digits(12)})\b", 0.85, validators=("vn_cccd_prefix",), gate=D12), near(rf"\b({digits(9)})\b", 0.70, gate=D9), Pattern("VNM" + digits(12) + "[FM]", 0.97, gate="VNM[0-9]")),
            words("CCCD; chứng minh nhân dân; chứng minh thư; CMND; CMND/CCCD; căn cước; căn cước công dân; giấy tờ tùy thân; số CCCD; số định danh; số định danh cá nhân; số định danh quốc gia; thẻ căn cước; VNeID; định danh điện tử"),
            words("có giá trị đến; căn cước gắn chip; cấp ngày; eID; hộ khẩu thường trú; ID number; identity; mã định danh; national ID; ngày cấp; nơi cấp; nơi thường trú; quê quán"),
            exclude_if_no_keywords=True,
            escalation=words("biometric; họ và tên; mật khẩu; ngày sinh; ngân hàng; password; sinh trắc học; thẻ tín dụng; tài khoản; vân tay; địa chỉ"), escalate_to="SECRET",
        ),
        Rule(
            "passport_001", "Passports", "pii", "CONFIDENTIAL", 0.88, 78,
            (
                near(r"\bB" + digits(8) + B, 0.88, override="SECRET", gate="B[0-9]{8}"), near(r"\bP" + digits(7) + B, 0.85, override="SECRET", gate="P[0-9]{7}"), near(r"\b(?:NG|C|X)" + digits("7,8") + B, 0.82, override="SECRET", gate="[GCX][0-9]{7}"),
                near(r"\b[A-Z]{1,2}" + digits("7,8") + B, 0.65, gate="[A-Z][0-9]{7}"), Pattern("P<VNM[<A-Z]{39}", 0.99, override="SECRET", gate="P<VNM"),
            ),
            words("hộ chiếu; passport; PASSPORT NO; passport number; số hộ chiếu; số hộ chiếu:; travel document; tài liệu du lịch"),
            words("date of expiry; date of issue; machine readable; MRZ; nationality; ngày cấp; ngày hết hạn; nơi sinh; place of birth; quốc tịch; visa; xuất nhập cảnh"),
            exclude_if_no_keywords=True,
        ),
        Rule(
            "social_insurance_001", "Social and health insurance numbers", "pii", "CONFIDENTIAL", 0.88, 75,
            (
                free(label("BHXH; bảo hiểm xã hội; social insurance") + r"\s*(?:number|no\.?|số|[:#])?\s*[=:]?\s*" + digits(10), 0.93, "bhxh", "hiểm", "insurance", gate=D10),
                Pattern(r"\bBH[A-Z0-9]{13}\b", 0.90, gate="BH[A-Z0-9]{13}"),
                free(label("BHYT; bảo hiểm y tế; health insurance") + r"\s*(?:number|no\.?|số|[:#])?\s*[=:]?\s*" + code("10,15"), 0.90, "bhyt", "hiểm", "insurance"),
                near(B + digits(10) + B, 0.68, gate=D10),
            ),
            words("BHXH; BHYT; bảo hiểm xã hội; bảo hiểm y tế; health insurance; social insurance; social security; số BHXH; số thẻ BHYT; sổ BHXH; thẻ BHYT"),
            words("BHXH tự nguyện; bảo hiểm thất nghiệp; hưu trí; lương hưu; mức đóng; phòng lao động; thai sản; tai nạn lao động; tử tuất; đóng bảo hiểm; ốm đau"),
            exclude_if_no_keywords=True,
        ),
        Rule(
            "phone_001", "Phone numbers", "pii", "INTERNAL", 0.82, 55,
            (
                Pattern(r"\b0" + MOBILE + B, 0.90, gate=D10), Pattern(r"\+84" + MOBILE + B, 0.92, gate=r"\+84[0-9]"), Pattern(r"\b84" + MOBILE + B, 0.88, gate="84[0-9]{9}"),
                near(r"\b02\d" + digits(8) + B, 0.80, gate="02[0-9]{9}"), near(r"\b1(?:80|90)0" + digits("4,6") + B, 0.70, gate="1[89]00[0-9]{4}"),
            ),
            words("di động; liên hệ; liên lạc; mobile; phone; số máy; số điện thoại; SĐT; tel; điện thoại"),
            words("cell; contact; ext; fax; gọi; hotline; nhắn tin; OTP; SMS; số máy lẻ; số nội bộ; số Zalo; Viber; xác thực số điện thoại; zalo; Zalo/Viber"),
        ),
        Rule(
            "email_001", "E-mail addresses", "pii", "INTERNAL", 0.75, 45,
            (
                Pattern(MAIL_LOCAL + own_mail, 0.98, override="INTERNAL", anchors=("@",)), Pattern(MAIL_LOCAL + MAIL_HOST + alt(["edu", "gov", "mil"]) + r"\.vn", 0.95, override="INTERNAL", anchors=(".vn",)),
                Pattern(MAIL_LOCAL + MAIL_HOST + f"[{LETTERS}]" + "{2,7}", 0.88, anchors=("@",)),
            ),
            words("e-mail; email; hộp thư; thư điện tử; địa chỉ email"),
            words("contact; gửi mail; inbox; liên hệ; liên lạc; địa chỉ thư"),
        ),
        Rule(
            "dob_001", "Birth dates", "pii", "INTERNAL", 0.72, 35,
            (
                near(B + DATE_SEP.join((DAY, MONTH, digits(4))) + B, 0.65, gate=r"[-/.][0-9]{4}"), near(B + DATE_SEP.join((digits(4), MONTH2, DAY2)) + B, 0.70, gate=r"[0-9]{4}[-/.]"),
                near(rf"\b{MONTH}[-/]{DAY}[-/]{digits(4)}\b", 0.60, gate=r"[-/][0-9]{4}"), Pattern(rf"\b{DAY}\s+tháng\s+{MONTH}\s+năm\s+(?:19|20){digits(2)}\b", 0.88, anchors=("tháng",)),
                near(r"\b(?:" + year("19") + r"|20[0-2]\d)\b", 0.45, gate="(?:19|20)[0-9]{2}"),
            ),
            words("birthdate; birthday; date of birth; DOB; ngày sinh; ngày sinh:; ngày tháng năm sinh; năm sinh; năm sinh:; sinh ngày; sinh năm"),
            words("age; birth certificate; born; giấy khai sinh; hồ sơ cá nhân; hồ sơ nhân sự; khai sinh; lý lịch; ngày sinh nhật; sinh ra; thông tin cá nhân; tuổi"),
            exclude_if_no_keywords=True,
        ),
        Rule(
            "vn_name_001", "Personal names", "pii", "INTERNAL", 0.70, 30,
            (
                near(alt(MORE_SURNAMES) + rf"\s+{NAME_WORD}(?:\s+{NAME_WORD}){{1,3}}", 0.75),
                free("(?:" + r"họ\s*" + r"(?:và\s*)?" + "tên|" + label("chủ tài khoản; full name; tên khách hàng; tên người dùng") + r")\s*[:]\s*" + alt(SURNAMES) + rf"\s+{NAME_WORD}(?:\s+{NAME_WORD})*", 0.90, "tên", "chủ", "name"),
            ),
            words("chủ sở hữu; chủ tài khoản; first name; full name; họ tên; họ tên đầy đủ; họ và tên; last name; người ký; người đại diện; tên chủ thẻ; tên khách hàng; tên người dùng; tên nhân viên; tên đầy đủ; đại diện pháp luật"),
            words("bên ký; bệnh nhân; chữ ký; giám đốc; hành khách; học sinh; khách hàng; ký tên; người dùng; người lập; người phê duyệt; nhân viên; sinh viên; trưởng phòng"),
            exclude_if_no_keywords=True,
        ),
    ]
    pair = lambda text, result, **k: Compound(text, tuple(text.split(" + ")), result, **k)
    compounds = (
        pair("pii + financial", "SECRET", least="CONFIDENTIAL"),
        pair("org_contract + pii", "CONFIDENTIAL"),
        pair("pii_vn_id + pii_phone + financial", "SECRET"),
        pair("pii_vn_id + pii_dob + pii_vn_name", "SECRET"),
        pair("credit_card + cvv", "SECRET", violation="PCI_DSS_3.3.1", alert="CRITICAL"),
        pair("credentials + internal_ip", "SECRET"),
        pair("org_contract + financial", "CONFIDENTIAL"),
        pair("org_email + classified_doc_001", "SECRET"),
        pair("org_email + classified_doc_002", "CONFIDENTIAL"),
        pair("pii_phone + financial", "CONFIDENTIAL"),
        pair("financial_swift_bic + financial_iban", "SECRET"),
        pair("pii_health + pii_vn_id", "SECRET", violation="HIPAA_PHI"),
        pair("pii_biometric + pii_vn_id", "SECRET", violation="BIOMETRIC_IDENTITY_COMBINATION"),
        pair("pii_passport + pii_vn_id", "SECRET"),
        pair("pii_health + financial", "SECRET", violation="HEALTH_FINANCIAL_COMBINATION"),
        pair("pii_biometric + financial", "SECRET", violation="BIOMETRIC_FINANCIAL_COMBINATION"),
        pair("pii_social_insurance + pii_vn_id", "SECRET"),
        pair("pii_email + pii_phone + pii_dob", "CONFIDENTIAL"),
        pair("credentials + pii_vn_id", "SECRET", violation="ACCOUNT_TAKEOVER_ENABLER"),
        pair("org_internal_ip + org_internal_code", "CONFIDENTIAL"),
    )
    return Catalog(tuple(rules), compounds, org.capped)


DEFAULT = build()
