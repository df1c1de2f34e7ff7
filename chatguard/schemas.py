"""Row layouts shared by the operators."""

FINDING = "struct<entity:string,start:int,end:int,confidence:double,subject:string,tier:int,note:string>"
FINDINGS = f"array<{FINDING}>"
EVENT = (
    "type string, channel string, user string, ts string, text string, subtype string, bot_id string, thread_ts string, "
    "edited struct<ts:string>, message struct<user:string,ts:string,text:string,subtype:string,bot_id:string,thread_ts:string,edited:struct<ts:string>>"
)
AUDIT = (
    "t double, id string, channel string, author string, text_hmac string, action string, rule string, entities array<string>, tier int, related int, "
    "timing_ms map<string,int>, model string, token_usage map<string,int>, tokens map<string,int>, usage map<string,int>, cost_usd double"
)
LABELLED = "ts string, user string, channel string, text string, label struct<entity:string,span:array<int>,subject:string>"
CASE = "id string, category string, text string, messages array<string>, channel string, different_authors boolean, expect string, known_gap boolean, needs_model boolean"
SINGLE = "array<struct<entity:string,text:string,subject:string,confidence:double>>"
WINDOW = "array<struct<entity:string,value:string,message_numbers:array<int>,confidence:double>>"
CODEBOOK = "array<struct<token:string,digit:string>>"

# Entities, subjects and actions by falling severity.
ENTITIES = ["CREDIT_CARD", "CARD_LIKE", "CA_SIN", "US_SSN", "API_KEY", "IBAN", "EMAIL", "PHONE", "ADDRESS", "DATE_OF_BIRTH", "HEALTH", "SPECIAL_CATEGORY", "PERSON"]
SUBJECTS = ["self", "third_party", "public", "unknown"]
SEVERITY = ["quarantine", "block", "mask", "warn", "log", "allow"]
REMOVING = ["mask", "block", "quarantine"]
