"""Patterns, word lists and lookups that results depend on. Java and RE2 read them alike unless noted."""

from __future__ import annotations

# Sender code to bank, first code that the sender contains wins.
SENDER_BANK = [
    ("HDFCBK", "HDFC"), ("HDFCBN", "HDFC"), ("HDFCSC", "HDFC"), ("SBIINB", "SBI"), ("SBIPSG", "SBI"), ("SBIUPI", "SBI"), ("SBISMS", "SBI"),
    ("ICICIB", "ICICI"), ("ICICIS", "ICICI"), ("ICICIT", "ICICI"), ("AXISBK", "AXIS"), ("AXISBN", "AXIS"), ("KOTAKB", "KOTAK"), ("KOTAKS", "KOTAK"),
    ("YESBNK", "YES"), ("YESBAK", "YES"), ("PAYTM", "PAYTM"), ("GPAY", "GPAY"), ("PHONEPE", "PHONEPE"), ("INDBNK", "INDIAN"), ("BOIIND", "BOI"),
    ("PNBSMS", "PNB"), ("CENTBK", "CENTRAL"), ("CANBNK", "CANARA"), ("UBOI", "UNION"), ("IDFCFB", "IDFC"), ("FEDBK", "FEDERAL"), ("BANDNK", "BANDHAN"),
    ("RBLBNK", "RBL"), ("DENABN", "DENA"), ("SYNBNK", "SYNDICATE"),
]
# Bank words in a body, in order.
BODY_BANK = [
    ("PHONEPE", "PHONEPE"), ("HDFC", "HDFC"), ("ICICI", "ICICI"), ("AXIS", "AXIS"), ("KOTAK", "KOTAK"), ("BANDHAN", "BANDHAN"), ("YES BANK", "YES"), ("SBI", "SBI"),
    ("PNB", "PNB"), ("BOI", "BOI"), ("CANARA", "CANARA"), ("UNION", "UNION"), ("IDFC", "IDFC"), ("FEDERAL", "FEDERAL"), ("PAYTM", "PAYTM"), ("GPAY", "GPAY"),
]

# Message patterns. A number always stands at the end of an amount or balance match.
_CURRENCY = r"(?:Rs\.?\s*|INR\s*|₹\s*)"
_NUMBER = r"([0-9,]+(?:\.[0-9]{1,2})?)"
AMOUNT = rf"{_CURRENCY}{_NUMBER}|(?:debited by|credited (?:with|by))\s+{_NUMBER}"
BALANCE = rf"(?:avl\.?\s*(?:bal(?:ance)?|amt)|avail(?:able)?\s*bal(?:ance)?|balance\s+(?:is\s+)?)[\s:]*{_CURRENCY}{_NUMBER}"
ACCOUNT = r"(?:a/?c|acct|account|card)\s*(?:no\.?\s*)?(?:[X*x]+\s*)([0-9]{4,6})|(?:ending|last\s+(?:4|four)\s+digits?)\s+(?:with\s+)?([0-9]{4})"
UPI_ANY = r"\b([a-zA-Z0-9._-]+@[a-zA-Z]{2,20})\b"
UPI = r"\b([a-zA-Z0-9._-]+@(?!(?:com|org|net|in|co|gov|edu)\b)[a-zA-Z]{2,20})\b"  # Java only
MODE = r"\b(NETBANKING|NET\s*BANKING|PHONEPE|PAYTM|NEFT|RTGS|IMPS|NACH|CASH|WALLET|CHEQUE|CHQ|ACH|ECS|UPI|ATM|POS|CARD)\b"
DEBIT = r"\b(debit(?:ed)?|spent|paid|sent|withdraw(?:n|al)?|purchase(?:d)?|charged|transfer(?:red)?|deducted)\b"
CREDIT = r"\b(credit(?:ed)?|received|deposited|refund(?:ed)?|cashback|reversed|added)\b"
FINANCIAL = r"(?:debit|credit|UPI|IMPS|NEFT|RTGS|Rs\.?|INR|₹|transaction|payment|withdraw|a/?c\s*[X*]*\d{4}|balance|transfer|ATM|POS|debited by|credited)"
REF = r"(?:Ref(?:\s*No)?|RefNo|Txn\s*(?:ID|No\.?)|Transaction\s*(?:ID|Number)|UPI\s*Ref|TxnNo|UTR|IMPS\s*Ref)[:\s-]*([A-Za-z0-9]{6,20})"
_NAME = r"([A-Za-z][A-Za-z0-9 &\x27._-]{1,35})"
PAYEE = [rf"(?:trf\s+to|transfer(?:red)?\s+to|paid\s+to|sent\s+to|to)\s+(?!block\b){_NAME}", rf"(?:withdrawn\s+at)\s+{_NAME}", r"(?:and\s+a/c\s+)([A-Za-z0-9*Xx]+)(?:\s+credited)"]  # Java only
PAYER = [r"linked\s+to\s+mobile\s+[0-9Xx]+\s*-\s*([A-Za-z][A-Za-z .]{1,35}?)\s*(?:\(|$)", rf"by\s+transfer\s+from\s+{_NAME}", rf"(?:transfer(?:red)?\s+from|received\s+from|from|\bby)\s+(?!\s*(?:Rs\.?|INR|₹)){_NAME}"]  # Java only
NOT_A_NAME = ["you", "u", "your", "a", "a/c", "ac", "the", "call", "block", "upi", "transfer"]
NAME_END = r"\s+(?:on|ref|via|txn|at|for|Refno|using|through|dated|dt|a/c|ac|account|avl|balance|info|from)\b"
SPAM_SENDER = r"(?:AIRTEL|JIO|VI|650025|BURKIN|ZUDIO|PTRENG|TATASKY|TATSKY|AMAZON)"
SPAM_BODY = (
    r"(?:recharge|data\s*pack|data\s*loan|validity|playlist|subscription|claim|OTT|netflix|jiohotstar|zee5|apple\s*music|free\s*access|call\s*alert"
    r"|hello\s*tune|missed\s*call|offer\s*expires|cashback\s*offer|discount\s*code|amazon\.in|flat\s*₹|chance\s*to\s*win|assured|free\s*delivery|win\s*₹)"
)
PHONE_SENDER = r"^\+?\d{10,}$"
SHORT_LINK = r"(?:h0a\.us|p-y\.tm|2lm\.in|ha2\.online|bit\.ly|tinyurl|t\.co/|goo\.gl|\b[a-z0-9-]+\.(?:us|online|xyz|link|club|site|top)/)"
GAMBLING = r"\b(?:rummy|teen\s*patti|casino|betting|bet\s*now|bonus\s*a/?c|withdraw\s*(?:it|now)|winning\s*amount|lottery|jackpot|rummy\s*bank)\b"
COLLECT = r"(?:has\s+requested|requested\s+(?:money|rs\.?|inr|₹)|requested\s+money\s+(?:from|on)|collect\s+request|(?:on|once)\s+approv(?:ing|ed)|will\s+be\s+debited\s+from\s+your)"
CONFIRMED = r"(?:recharge of (?:inr|rs)[\d.,\s]+is success|recharge of rs[\d.,\s]+successfully credited|prepaid recharge of rs[\d.,\s]+is success|we have processed rs[\d.,\s]+for your|\bINB txn of rs|thank you for the payment of rs)"
TELECOM = r"(?:for your airtel mobile|to your airtel|airtel prepaid|prepaid recharge of|recharge of (?:inr|rs)[\d.,\s]+is success)"
MANDATE = r"(?:UPI[-\s]?Mandate for|e-?mandate\b|mandate .{0,25}(?:created|set\s?up)|autopay .{0,25}(?:created|set\s?up))"
OTP = r"\b(?:otp|one[-\s]*time\s*password|verification\s*code|auth(?:entication)?\s*code|login\s*code|passcode|secure\s*code)\b"
PROMOTION = r"\b(?:cashback|offer(?:s)?|discount|promo(?:tion)?|loan|credit\s*card|insurance|recharge\s*offer|sale|deal|ad(?:vertisement)?|apply\s*now|buy\s*now|subscribe|install\s*app|win\s*\w*|free\s*delivery|festival\s*offer|shopping\s*offer)\b"
PROMOTION_PLAIN = r"\b(use code|code:|win\b|cashback|assured|chance to win|apply now|buy now|order now|offer|coupon)\b"
PAID_SUMMARY = r"\b(payment summary|payment successful|transaction of|transaction is successful|your transaction|payment processed|you paid|payment of|you paid using|you paid via)\b"
CONDITIONAL = r"\b(payment is being processed|in case the payment fails|will be added as previous dues|may be added as previous dues|added as previous dues|payment pending|request(?:ed)? money from you)\b"
ALERT = r"\b(?:kyc\s*reminder|statement\s*available|e[-\s]*statement|password\s*changed|card\s*blocked|card\s*dispatched|security\s*(?:alert|notification)|account\s*locked|otp\s*for\s*login|profile\s*updated|address\s*updated|mobile\s*number\s*updated)\b"
FAILED = r"\b(?:failed|declined|pending|reversed|timed\s*out|cancelled|canceled|unsuccessful|rejected|could\s*not\s*process|unable\s*to\s*process)\b"
BILL = r"\b(?:bill\s*reminder|payment\s*due|due\s*date|outstanding\s*amount|emi\s*due|utility\s*bill|electricity\s*bill|water\s*bill|gas\s*bill|statement\s*due|reminder\s*to\s*pay)\b"
CONTEXT = r"\b(?:debited?|credited?|withdrawn?|withdrawal|deposited?|transferred?|transfer|paid|received|sent|purchase(?:d)?|charged|deducted|refund(?:ed)?|cashback|imps|neft|rtgs|upi|atm|pos|card|transaction|payment)\b"
BALANCE_WORD = r"\b(?:balance|avl\.?\s*bal|available\s*balance|avail(?:able)?\s*bal|remaining\s*balance)\b"
VERB = r"\b(debited|credited|paid|sent|received|transferred|withdrawn|deposited)\b"
BONUS_WORD = r"\b(refund|cashback|salary|stipend|interest)\b"
REF_WORD = r"\b(refno|ref\s*no|txn|utr|transaction\s*(?:id|number)|imps\s*ref|upi\s*ref)\b"
ACCOUNT_WORD = r"\b(account|a/?c|bank|branch)\b"
NOISE = r"\b(?:LTD|LIMITED|PVT|PRIVATE|SERVICES|SERVICE|CITY|MUMBAI|DELHI|PUNE|BANGALORE|BENGALURU|HYDERABAD|CHENNAI|KOLKATA|NOIDA|GURGAON|CORP|CORPORATION|ENTERPRISES|INDIA)\b"
ACCOUNT_NOISE = r"\b(?:A/C|AC|ACC|ACCOUNT|CARD|BALANCE|AVL|AVAILABLE|AVAIL)\b"
BRAND = r"\b(Rapido|Uber|Ola|Swiggy|Zomato|Amazon|Flipkart|Myntra|Airtel|Jio|Vi|Blinkit|Zepto)\b"

# Statement narrations. Groups by position.
_TYPE = r"((?:WDL|DEP)\s+TFR)"
NARRATION = {
    "MAIN": _TYPE + r"\s+([A-Za-z]+)/(DR|CR)/(\d+)/([^/]+)/([A-Za-z]+)/([^\s/]+)(?:\s*-?\d+/([A-Za-z]+))?",
    "IMPS_B": _TYPE + r"\s+(?:INB\s+)?IMPS/(\d+)/([A-Za-z0-9]{2,5})-[Xx]{2}(\d+)-([^/]+?)\s*/\s*([^\d/]*?)\s+\d{6,}\s+AT",
    "IMPS_A": _TYPE + r"\s+INB\s+IMPS(\d+)/([^/]+)/XX(\d+)/\s*([^\d/]+?)\s+\d{6,}\s+AT",
    "NEFT": _TYPE + r"\s+NEFT\*([A-Za-z0-9]+)\*([A-Za-z0-9]+)\*([^\d/]+?)\s+\d{6,}\s+AT",
    "UPI_REVERSAL": _TYPE + r"\s+UPI/(?:(\d+)/REVERSAL|REV/(\d+))",
    "ATM": r"(?i)ATM\s*WDL\s+ATM\s*CASH\s+(.+)",
    "ATM_FEE": r"(?i)DEBIT\s+ATMCard\s+AMC",
    "INTEREST": r"(?i)INTERES\s*T?\s*CREDIT",
    "INSURANCE": r"(?i)PMJJBY|PMSBY",
    "CHEQUE": r"(?i)CLEARING\s*/\s*CHEQUE",
    "POS": r"POS\s+ATM\s+PURCH.*?\d{4,}\s*([A-Z][A-Za-z ]+)$",
    "OF_NAME": _TYPE + r".*?\bO\s?F\b\s+(.+?)\s+AT\s+\d",
    "INB_ENTITY": _TYPE + r"\s+INB\s+([A-Za-z][A-Za-z0-9 ._-]{3,}?)\s+\d{6,}\s*(?:OF|AT)",
}
MODE_WORDS = ["UPI", "INB", "IMP", "NEFT", "RTGS", "Cheque", "Cash Deposit", "Cash Withdrawal", "POS", "DD", "SWIFT", "Wire Transfer", "ECS", "Bill Pay", "M-wallet", "EMI", "EFT", "ACH"]
CIF = r"(?i)\bCIF\s*:?\s*\d+"
# Labels that stand for a payee, titles, and the modes a ledger knows.
SENTINELS = ["UNKNOWN", "PHONE_TRANSFER", "ATM_WITHDRAWAL", "BANK_FEE", "INTEREST_CREDIT", "INSURANCE_PREMIUM", "CHEQUE_CLEARING", "REVERSAL"]
TITLES = ["MR", "MRS", "MS", "MISS", "DR"]
LEDGER_MODES = ["UPI", "INB", "NEFT", "IMPS", "CARD", "CASH", "NETBANKING", "ACH", "ATM", "POS", "RTGS"]
# Header spellings of a statement and the column each stands for.
HEADER_ALIASES = {
    "date": "Transaction_Date", "transaction_date": "Transaction_Date", "details": "Description", "description": "Description",
    "ref no./cheque no.": "Reference No./Cheque No.", "reference no./cheque no.": "Reference No./Cheque No.", "ref no./cheque no": "Reference No./Cheque No.",
    "ref no.": "Reference No./Cheque No.", "ref no": "Reference No./Cheque No.", "cheque no.": "Reference No./Cheque No.", "cheque no": "Reference No./Cheque No.",
    "debit": "Debit", "credit": "Credit", "balance": "Balance", "transaction_mode": "Transaction_Mode", "transaction mode": "Transaction_Mode",
    "dr/cr_indicator": "DR/CR_Indicator", "dr/cr indicator": "DR/CR_Indicator", "recipient_name": "Recipient_Name", "recipient name": "Recipient_Name",
    "upi_id": "UPI_ID", "upi id": "UPI_ID", "bank": "Bank", "note": "Note", "amount": "Amount", "transaction_id": "Transaction_ID", "transaction id": "Transaction_ID",
}
STATEMENT_COLUMNS = ["Transaction_Date", "Description", "Transaction_Type", "Transaction_Mode", "DR/CR_Indicator", "Transaction_ID", "Recipient_Name", "Recipient_Canonical", "Bank", "UPI_ID", "Note", "Debit", "Credit", "Balance", "Amount", "Reference No./Cheque No."]

# Keyword categories by falling confidence (keywords as whole words, stems anywhere).
KEYWORD_CATEGORIES = [
    ("FOOD", 0.91, "swiggy zomato restaurant cafe food pizza burger dining hotel bakery kitchen".split(), ["food", "restaurant", "dining"]),
    ("HEALTH", 0.90, "hospital clinic pharmacy doctor medical health medicine drugstore lab diagnostic".split(), ["health", "medical", "pharmacy"]),
    ("TRAVEL", 0.89, "uber ola rapido fuel petrol diesel taxi auto cab flight hotel booking parking".split(), ["travel", "transport", "fuel"]),
    ("ENTERTAINMENT", 0.88, ["netflix", "spotify", "amazon prime", "hotstar", "zee", "movie", "cinema", "theater", "game", "gaming"], ["entertain", "stream"]),
    ("EDUCATION", 0.87, "school college university course tuition fees learning exam book educational".split(), ["education", "school", "course"]),
    ("SHOPPING", 0.86, "amazon flipkart myntra shopping mall store retail shop apparel fashion shoes clothes".split(), ["shop", "retail"]),
    ("BILLS", 0.84, "rent electricity water internet bill utility bsnl airtel jio gas phone postpaid".split(), ["bill", "utility"]),
]
# Payee words that mean a business, a brand, an institution; none of them names a person.
BUSINESS = (
    r"(HOTEL|STORE|MART\b|FOOD|SWEET|PVT|\bLTD\b|PHARMAC|MEDICAL|RESTAURAN|CAFE|KITCHEN|BAKER|TRAVEL|CENTRE|CENTER|SERVIC|ENTERPRIS|TRAD|AGENC|SHOP|DAIRY|JUICE"
    r"|TECHNOLOG|\bTECH\b|SOLUTION|\bSOL\b|SYSTEM|VENTURE|INDUSTR|CORP|COMPAN|GROUP|FOUNDATION|TRUST|SOCIETY|\bBANK\b|INSURANC|UNIVERSIT|COLLEGE|SCHOOL|INSTITUT"
    r"|HOSPITAL\b|CLINIC|CHEMIS|DIAGNOSTIC|MALL\b|PLAZA|COMPLEX|BRANDS|FASHION|FAST ?FOOD|ROLLS|BURGER|PIZZA|CHANA ?BHANDAR|SNACKS?|BEVERAGE|ONLINE|DIGITAL|EDUCATION"
    r"|ACADEMY|COACHING|ELECTRONIC|CINEMA|DEPOT|BOOK ?DEPOT|GENERAL\b|ESCAPE ?ROOM|MYSTERY ?ROOM|SHARBAT|WALE\b|DHABA|BHEL|VADA ?PAV|MEDIC|SUPERMARKET|PROVISION"
    r"|CATERER|BANQUET|CLOTHING|GARMENTS|JEWELL?ERS?|SALON|SPA\b|GYM\b|FITNESS|HOSPITALITY|\bLLP\b|\bLLC\b|\bINC\b|PAYMENT|STATIONAR|STATIONER|SOFTW)"
)
BRANDS = (
    r"(ZOMATO|SWIGGY|AMAZON|FLIPKART|GOOGLE|PAYTM|PHONEPE|AIRTEL|\bJIO\b|NETFLIX|HOTSTAR|SPOTIFY|\bUBER\b|\bOLA\b|IRCTC|MYNTRA|AJIO|BIGBASKET|BLINKIT|ZEPTO|DUNZO"
    r"|DOMINOS?|MCDONALD|\bKFC\b|STARBUCKS|BHARTIPAY|BHARATPE|MOBIKWIK|RAZORPAY|\bSLICE\b|GROUPON|PIZZA ?HUT|SUBWAY|BURGER ?KING|CCD\b|CAFE ?COFFEE|HALDIRAM|AMUL|NESTLE"
    r"|CRED\b|CCAVENUE|AVENUES|VODAFONE|\bVI\b|IDEA\b)"
)
# Institutions, routing and machine codes, income, labels that name no one.
INSTITUTIONS = r"\bIITM\b|\bIIT\b|\bW ?RLY\b|RAILWAY|\bRLY\b|METR"
ROUTING_CODE, ATM_CODE, INCOME = r"\bCBSSB", r"^ATM|\bATM\b", r"\bSTIPEND\b|\bSALARY\b|\bPAYROLL\b|\bDIVIDEND\b"
GENERIC_LABELS = ["BILLPAY", "LOANREPAYMENT", "LOANREP", "TRANSFER", "TRANSFR", "IMPSTRANSFER", "IMPSTRAN", "FAMILY", "FRIENDS", "SELF", "CASHDEPOSIT"]
GARBAGE = r"CHEQUE|\bCSB\b|^MMRDA$|^SBIMOPS$|^UNKNOWN$|^NAN$"
NO_PAYEE = ["PHONE_TRANSFER", "UNKNOWN", "NAN", ""]
# Payee words and the category of each, in order.
PAYEE_CATEGORIES = [
    ("Food / Dine Out", r"ZOMATO|SWIGGY|HOTEL|RESTAURAN|CAFE|KITCHEN|FOOD|SWEET|JUICE|DAIRY|BURGER|ROLLS|BAKER|SNACKS?|MCDONALD|KFC|STARBUCKS|DOMINOS?|CHANA ?BHANDAR|PIZZA|SHARBAT|WALE|DHABA|BHEL|VADA ?PAV|SUBWAY|CCD|CAFE ?COFFEE|HALDIRAM|AMUL|NESTLE"),
    ("Medical", r"PHARMAC|MEDICAL|CLINIC|HOSPITAL\b|DIAGNOSTIC|CHEMIS|MEDIC\b"),
    ("Subscriptions", r"AIRTEL|JIO\b|NETFLIX|HOTSTAR|SPOTIFY|RECHARGE|VODAFONE|\bVI\b|IDEA\b"),
    ("Travel", r"IRCTC|UBER|OLA\b|TRAVEL|METR|MMRDA|\bW ?RLY\b|RAILWAY|\bRLY\b"),
    ("Shopping", r"AMAZON|FLIPKART|MYNTRA|AJIO|MALL\b|SHOP|STORE|MART\b|BOOK ?DEPOT|CLOTHING|GARMENTS|JEWELL?ERS?"),
    ("Groceries", r"BIGBASKET|BLINKIT|ZEPTO|DUNZO|GROCER|SUPERMARKET|PROVISION"),
    ("Fees & Debt", r"UNIVERSIT|COLLEGE|SCHOOL|INSTITUT|EDUCATION|ACADEMY|COACHING|\bIITM\b|\bIIT\b"),
    ("Entertainment", r"CINEMA|MYSTERY ?ROOM|ESCAPE ?ROOM"),
    ("Cosmetics", r"SALON|SPA\b|GYM\b|FITNESS"),
]
