"""Rule tables: plain data used by the name functions and by discovery.

The words, weights and limits are parity constants: results are to be those that users of such rules know, so the values are given, not chosen here.
Their order has no meaning, except in BUSINESS_ENTITIES and CONVENTIONS, where the first match wins.
"""

GENERIC_TOKENS = frozenset("CODE ID KEY NAME NUMBER VALUE".split())
TABLE_PREFIXES = frozenset("BRG BRIDGE DIM DW FACT FCT HUB LNK OD ODS SAT STG T TBL TMP TMPV VIEW VW".split())
#: Words that describe a table without naming its entity.
TABLE_SUFFIXES = frozenset("DATA INFO LIST MASTER PROFILE TABLE".split())
KEY_SUFFIXES = tuple("KEY ID CODE NO NUM NBR NUMBER NR ABBR SEQ REF IDX UUID GUID SK PK".split())
NATURAL_SUFFIXES = frozenset("ABBR CODE NBR NO NR NUM".split())
ORDINAL_SUFFIXES = frozenset("IDX NBR NO NR NUM NUMBER SEQ".split())
SURROGATES = frozenset("AUTO_ID ENTITY_ID RECORD_ID ROW_ID SEQUENCE_ID SERIAL_ID UNIQUE_ID".split())
NOT_IDENTIFIERS = frozenset("ADDRESS AMOUNT AMT AVAIL BAL BALANCE COMMENT COST DATE DESC DESCRIPTION EMAIL NAME PHONE PRICE QTY QUANTITY TEXT TIME TIMESTAMP".split())
CONTENT_WORDS = frozenset("ABSTRACT BODY CATEGORY CLASS COMMENT COMMENTS CONTENT DESC DESCRIPTION DETAILS FLAG FLAGS GRADE KIND LABEL LEVEL MEMO MESSAGE MODE NAME NOTE NOTES PHASE PRIORITY RANK REMARKS STAGE STATE STATUS SUMMARY TEXT TITLE TYPE TYPES".split())
MEASURE_WORDS = frozenset("AMOUNT BALANCE COST COUNT PREMIUM PRICE QTY QUANTITY RATE SCORE SUBTOTAL SUM TOTAL".split())
TIME_WORDS = frozenset("DATE DATETIME DAY DT HOUR TIME TIMESTAMP".split())
SYSTEM_ACTIONS = frozenset("CREATED DELETED INSERTED LOADED MODIFIED SYNCED UPDATED".split())
AUDIT_ACTORS = frozenset("APPROVED_BY ASSIGNED_TO CREATED_BY DELETED_BY MODIFIED_BY OWNED_BY REVIEWED_BY UPDATED_BY".split())
PERSON_TABLES = frozenset("ACCOUNT EMPLOYEE PERSON STAFF USER".split())
ABBREVIATIONS = dict(
    pair.split("=")
    for pair in (
        "ACCT=ACCOUNT ADDR=ADDRESS AMT=AMOUNT CAT=CATEGORY CNTRY=COUNTRY CONV=CONVERSATION CTG=CATEGORY CURR=CURRENCY CUST=CUSTOMER DEPT=DEPARTMENT "
        "DESC=DESCRIPTION DIV=DIVISION DOC=DOCUMENT EMP=EMPLOYEE GRP=GROUP INV=INVOICE LOC=LOCATION MGR=MANAGER NUM=NUMBER ORD=ORDER "
        "ORG=ORGANIZATION PROD=PRODUCT PROJ=PROJECT QTY=QUANTITY REF=REFERENCE REG=REGION SUPP=SUPPLIER TRANS=TRANSACTION TXN=TRANSACTION USR=USER "
        "VEND=VENDOR WHSE=WAREHOUSE"
    ).split()
)
SELF_REFERENCE = tuple("ANCESTOR BOSS MANAGER MGR PARENT PREDECESSOR REFERRED_BY REFERRER REPORTS_TO REPORT_TO SUPERVISOR".split())
ROLE_WORDS = {
    "bridge": frozenset("ASSOC ASSOCIATION BRG BRIDGE JUNCTION LINK REL XREF".split()),
    "staging": frozenset("LANDING RAW STAGING STG TEMP TMP WORK".split()),
    "fact": frozenset("EVENT FACT FCT LOG ORDER SALE TRANSACTION TXN".split()),
    "dimension": frozenset("DIM DIMENSION LOOKUP MASTER REF REFERENCE".split()),
}
OPTIONAL_WORDS = frozenset("ALTERNATE BACKUP COUPON DISCOUNT FALLBACK OPTIONAL PROMO PROMOTION SECONDARY TEMP TMP".split())
FILTER_SUFFIXES = frozenset("CATEGORY CODE FLAG LEVEL MODE PRIORITY SEGMENT STATUS TYPE".split())
NULLISH = tuple("|N/A|NA|NAN|NONE|NOT AVAILABLE|NULL".split("|"))
NOISE_TABLES = (
    r"^(tmp|temp|test|bak|backup|old|copy|scratch|sandbox|debug|dummy|sample|stg|staging)_",
    r"_(tmp|temp|test|bak|backup|old|copy|archive|archived|hist|snapshot|deprecated|debug|dummy)$",
    r"_v\d+$", r"_ver\d+$", r"_(19|20)\d{6}$", r"_(19|20)\d{4}$", r"_(19|20)\d{2}_\d{2}(_\d{2})?$", r"_(bak|backup|copy|old|tmp|temp)_?\d+$", r"^_|^\$",
)
#: entity -> (words in names of tables, words in names of keys).
BUSINESS_ENTITIES = {
    kind: (tuple(tables.split()), tuple(keys.split()))
    for kind, tables, keys in (
        ("customer", "ACCOUNT_HOLDER CLIENT CUST MEMBER USER", "CLIENT_ID CUST_ID CUSTOMER_ID MEMBER_ID USER_ID"),
        ("product", "CATALOG INVENTORY ITEM PRODUCT SKU", "ITEM_ID PRODUCT_ID PRODUCT_KEY SKU"),
        ("order", "ORDER PURCHASE SALE TRANSACTION", "ORDER_ID ORDER_NUMBER SALE_ID TRANSACTION_ID"),
        ("date", "CALENDAR DATE TIME", "DATE_ID DATE_KEY TIME_ID"),
        ("location", "ADDRESS GEOGRAPHY LOCATION REGION TERRITORY", "ADDRESS_ID GEO_ID LOCATION_ID REGION_ID"),
        ("employee", "EMPLOYEE PERSONNEL STAFF WORKER", "EMP_ID EMPLOYEE_ID STAFF_ID"),
    )
}
ENTITY_PAIRS = {
    tuple(pair.split()): points
    for points, pairs in ((0.3, "order date"), (0.25, "order customer/order product"), (0.2, "customer location/order employee"), (0.15, "employee location/product location"))
    for pair in pairs.split("/")
}
USUAL_FKS = {
    "customer": tuple("ACCOUNT_ID CLIENT_ID CUST_ID CUSTOMER_ID USER_ID".split()),
    "product": tuple("CATALOG_ID ITEM_ID PROD_ID PRODUCT_ID SKU".split()),
    "date": tuple("DATE_ID DATE_KEY".split()),
    "location": tuple("ADDRESS_ID BILL_TO_ID LOCATION_ID SHIP_TO_ID STORE_ID WAREHOUSE_ID".split()),
}
CONVENTIONS = {
    "fact": tuple("ACTIVITY_ EVENTS_ FACT_ FCT_ F_ METRICS_ ORDERS_ REVENUE_ SALES_ TRANSACTIONS_".split()),
    "dimension": tuple("DIM_ D_ LKP_ LOOKUP_ MASTER_ REF_".split()),
    "bridge": tuple("ASSOC_ BRG_ BRIDGE_ LINK_ MAP_ XREF_".split()),
    "staging": tuple("LANDING_ RAW_ STAGING_ STG_ TEMP_ TMP_".split()),
}
CALENDAR_WORDS = tuple("DATE DAY MONTH QUARTER WEEK YEAR".split())
PATTERN_POINTS = {"bridge": 0.1, "snowflake": 0.15, "star": 0.2, "time": 0.25}
CATEGORICAL = frozenset("BOOLEAN CHAR CHARACTER NCHAR NVARCHAR STRING TEXT UUID VARCHAR".split())
TEMPORAL = frozenset("DATE DATETIME TIME TIMESTAMP TIMESTAMP_LTZ TIMESTAMP_NTZ TIMESTAMP_TZ".split())
INTEGERS = frozenset("BIGINT INT INTEGER SMALLINT TINYINT".split())
NUMERIC = INTEGERS | frozenset("DECIMAL DOUBLE FLOAT NUMBER NUMERIC REAL".split())
OBJECTS = frozenset("ARRAY BINARY GEOGRAPHY JSON MAP OBJECT STRUCT VARBINARY VARIANT VECTOR VOID".split())
METRIC_WORDS = {
    "avg": frozenset("average avg expected mean typical".split()),
    "count": frozenset("count headcount number volume".split()),
    "distinct": frozenset("deduplicated distinct unique".split()),
    "sum": frozenset("amount gmv margin profit revenue sales sum total turnover".split()),
    "product": frozenset("extended multiplied multiply net product times".split()),
}
METRIC_PHRASES = {"avg": ("per order", "per customer"), "count": ("number of", "how many"), "product": ("product of",)}
