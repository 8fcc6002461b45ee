"""Compact dictionaries of public FIX facts, written by hand. Full files can be loaded beside them.

One line a definition. Fields: `number name type code=DESCRIPTION ...`. Contents: names in order, `!` behind a
required one, `@` before a component, parentheses after a count field around its group. Messages:
`type category name: contents`.
"""

from __future__ import annotations

HEADER = "BeginString! BodyLength! MsgType! SenderCompID! TargetCompID! OnBehalfOfCompID DeliverToCompID MsgSeqNum! SenderSubID SenderLocationID TargetSubID TargetLocationID PossDupFlag SendingTime!"
TRAILER = "SignatureLength Signature CheckSum!"

COMMON_FIELDS = """
8 BeginString STRING
9 BodyLength LENGTH
10 CheckSum STRING
34 MsgSeqNum SEQNUM
43 PossDupFlag BOOLEAN
49 SenderCompID STRING
50 SenderSubID STRING
52 SendingTime UTCTIMESTAMP
56 TargetCompID STRING
57 TargetSubID STRING
89 Signature DATA
93 SignatureLength LENGTH
115 OnBehalfOfCompID STRING
128 DeliverToCompID STRING
142 SenderLocationID STRING
143 TargetLocationID STRING
7 BeginSeqNo SEQNUM
16 EndSeqNo SEQNUM
36 NewSeqNo SEQNUM
45 RefSeqNum SEQNUM
58 Text STRING
95 RawDataLength LENGTH
96 RawData DATA
98 EncryptMethod INT 0=NONE_OTHER
108 HeartBtInt INT
112 TestReqID STRING
123 GapFillFlag BOOLEAN
141 ResetSeqNumFlag BOOLEAN
371 RefTagID INT
372 RefMsgType STRING
373 SessionRejectReason INT
553 Username STRING
554 Password STRING
"""

SESSION_MESSAGES = """
0 admin Heartbeat: TestReqID
1 admin TestRequest: TestReqID!
2 admin ResendRequest: BeginSeqNo! EndSeqNo!
3 admin Reject: RefSeqNum! RefTagID RefMsgType SessionRejectReason Text
4 admin SequenceReset: GapFillFlag NewSeqNo!
5 admin Logout: Text
A admin Logon: EncryptMethod! HeartBtInt! RawDataLength RawData ResetSeqNumFlag {logon}
"""

ORDER_FIELDS = """
1 Account STRING
6 AvgPx PRICE
11 ClOrdID STRING
14 CumQty QTY
15 Currency CURRENCY
17 ExecID STRING
18 ExecInst MULTIPLEVALUESTRING 1=NOT_HELD G=ALL_OR_NONE
19 ExecRefID STRING
21 HandlInst CHAR 1=AUTOMATED_EXECUTION_ORDER_PRIVATE 2=AUTOMATED_EXECUTION_ORDER_PUBLIC 3=MANUAL_ORDER
30 LastMkt EXCHANGE
31 LastPx PRICE
32 LastQty QTY
37 OrderID STRING
38 OrderQty QTY
39 OrdStatus CHAR 0=NEW 1=PARTIALLY_FILLED 2=FILLED 3=DONE_FOR_DAY 4=CANCELED 5=REPLACED 6=PENDING_CANCEL 7=STOPPED 8=REJECTED 9=SUSPENDED A=PENDING_NEW B=CALCULATED C=EXPIRED D=ACCEPTED_FOR_BIDDING E=PENDING_REPLACE
40 OrdType CHAR 1=MARKET 2=LIMIT 3=STOP 4=STOP_LIMIT
41 OrigClOrdID STRING
44 Price PRICE
48 SecurityID STRING
53 Quantity QTY
54 Side CHAR 1=BUY 2=SELL 3=BUY_MINUS 4=SELL_PLUS 5=SELL_SHORT 6=SELL_SHORT_EXEMPT 7=UNDISCLOSED 8=CROSS 9=CROSS_SHORT
55 Symbol STRING
59 TimeInForce CHAR 0=DAY 1=GOOD_TILL_CANCEL 2=AT_THE_OPENING 3=IMMEDIATE_OR_CANCEL 4=FILL_OR_KILL 6=GOOD_TILL_DATE
60 TransactTime UTCTIMESTAMP
63 SettlType CHAR 0=REGULAR 1=CASH 2=NEXT_DAY
64 SettlDate LOCALMKTDATE
70 AllocID STRING
71 AllocTransType CHAR 0=NEW 1=REPLACE 2=CANCEL
73 NoOrders NUMINGROUP
75 TradeDate LOCALMKTDATE
78 NoAllocs NUMINGROUP
79 AllocAccount STRING
80 AllocQty QTY
97 PossResend BOOLEAN
99 StopPx PRICE
102 CxlRejReason INT 0=TOO_LATE_TO_CANCEL 1=UNKNOWN_ORDER
103 OrdRejReason INT 0=BROKER_OPTION 1=UNKNOWN_SYMBOL
150 ExecType CHAR 0=NEW 3=DONE_FOR_DAY 4=CANCELED 5=REPLACED 6=PENDING_CANCEL 7=STOPPED 8=REJECTED 9=SUSPENDED A=PENDING_NEW B=CALCULATED C=EXPIRED E=PENDING_REPLACE F=TRADE G=TRADE_CORRECT H=TRADE_CANCEL I=ORDER_STATUS
151 LeavesQty QTY
152 CashOrderQty QTY
190 LastSpotRate PRICE
193 SettlDate2 LOCALMKTDATE
378 ExecRestatementReason INT
424 DayOrderQty QTY
425 DayCumQty QTY
434 CxlRejResponseTo CHAR 1=ORDER_CANCEL_REQUEST 2=ORDER_CANCEL_REPLACE_REQUEST
447 PartyIDSource CHAR B=BIC C=GENERALLY_ACCEPTED_MARKET_PARTICIPANT_IDENTIFIER D=PROPRIETARY_CUSTOM_CODE
448 PartyID STRING
452 PartyRole INT 1=EXECUTING_FIRM 3=CLIENT_ID 4=CLEARING_FIRM
453 NoPartyIDs NUMINGROUP
523 PartySubID STRING
626 AllocType INT 1=CALCULATED 2=PRELIMINARY
636 WorkingIndicator BOOLEAN
790 OrdStatusReqID STRING
802 NoPartySubIDs NUMINGROUP
803 PartySubIDType INT
857 AllocNoOrdersType INT 0=NOT_SPECIFIED 1=EXPLICIT_LIST_PROVIDED
262 MDReqID STRING
268 NoMDEntries NUMINGROUP
269 MDEntryType CHAR 0=BID 1=OFFER 2=TRADE
270 MDEntryPx PRICE
271 MDEntrySize QTY
272 MDEntryDate UTCDATEONLY
273 MDEntryTime UTCTIMEONLY
1036 ExecAckStatus CHAR 0=RECEIVED 1=ACCEPTED 2=DONT_KNOW 3=REJECTED 4=ACCEPTED_WITH_ERRORS
"""

COMPONENTS = """
Instrument: Symbol! SecurityID
OrderQtyData: OrderQty CashOrderQty
Parties: NoPartyIDs ( PartyID PartyIDSource PartyRole @PtysSubGrp )
PtysSubGrp: NoPartySubIDs ( PartySubID PartySubIDType )
PreAllocGrp: NoAllocs ( AllocAccount AllocQty )
OrdAllocGrp: NoOrders ( ClOrdID OrderID OrderQty )
MDFullGrp: NoMDEntries! ( MDEntryType! MDEntryPx MDEntrySize MDEntryDate MDEntryTime )
"""

ORDER_MESSAGES = """
D app NewOrderSingle: ClOrdID! @Parties TradeDate Account @PreAllocGrp SettlType SettlDate HandlInst ExecInst @Instrument Side! TransactTime! @OrderQtyData OrdType! Price StopPx Currency TimeInForce Text
8 app ExecutionReport: OrderID! ClOrdID OrigClOrdID ExecID! ExecRefID ExecType! OrdStatus! WorkingIndicator OrdRejReason ExecRestatementReason Account SettlType SettlDate @Instrument Side! @OrderQtyData OrdType Price StopPx Currency TimeInForce ExecInst LastQty LastPx LastSpotRate LastMkt LeavesQty! CumQty! AvgPx! DayOrderQty DayCumQty TradeDate TransactTime HandlInst Text
F app OrderCancelRequest: OrigClOrdID! OrderID ClOrdID! Account @Parties @Instrument Side! TransactTime! @OrderQtyData Text
G app OrderCancelReplaceRequest: OrderID @Parties TradeDate OrigClOrdID! ClOrdID! Account @PreAllocGrp SettlType SettlDate HandlInst ExecInst @Instrument Side! TransactTime! @OrderQtyData OrdType! Price StopPx Currency TimeInForce Text
H app OrderStatusRequest: OrderID ClOrdID! OrdStatusReqID Account @Instrument Side!
9 app OrderCancelReject: OrderID! ClOrdID! OrigClOrdID! OrdStatus! WorkingIndicator Account CxlRejResponseTo! CxlRejReason Text
J app AllocationInstruction: AllocID! AllocTransType! AllocType! AllocNoOrdersType! @OrdAllocGrp Side! @Instrument Quantity! AvgPx! TradeDate! Text
W app MarketDataSnapshotFullRefresh: MDReqID @Instrument @MDFullGrp
BN app ExecutionAcknowledgement: OrderID! ClOrdID ExecAckStatus! ExecID! @Instrument Side! OrderQty LastQty LastPx AvgPx Text
"""

#: key: (version attributes, logon extras, own fields, replaced fields)
BUILTIN = {
    "FIX40": (("FIX", "4", "0", ""), "", ""),
    "FIX41": (("FIX", "4", "1", ""), "", ""),
    "FIX42": (("FIX", "4", "2", ""), "", "20 ExecTransType CHAR 0=NEW 1=CANCEL 2=CORRECT 3=STATUS"),
    "FIX43": (("FIX", "4", "3", ""), "Username Password", ""),
    "FIX44": (("FIX", "4", "4", ""), "Username Password", ""),
    "FIX50": (("FIX", "5", "0", ""), None, ""),
    "FIX50SP1": (("FIX", "5", "0", "1"), None, ""),
    "FIX50SP2": (("FIX", "5", "0", "2"), None, "1057 AggressorIndicator BOOLEAN"),
    "FIXT11": (("FIXT", "1", "1", ""), "DefaultApplVerID!", "1128 ApplVerID STRING 0=FIX27 1=FIX30 2=FIX40 3=FIX41 4=FIX42 5=FIX43 6=FIX44 7=FIX50 8=FIX50SP1 9=FIX50SP2\n1137 DefaultApplVerID STRING 7=FIX50 8=FIX50SP1 9=FIX50SP2"),
}

#: The code of an application version and the dictionary that stands for it.
APPL_VERSIONS = {"0": "FIX27", "1": "FIX30", "2": "FIX40", "3": "FIX41", "4": "FIX42", "5": "FIX43", "6": "FIX44", "7": "FIX50", "8": "FIX50SP1", "9": "FIX50SP2"}
ALIASES = {"FIX27": "FIX40", "FIX30": "FIX40"}
SESSION_FALLBACK = {"FIX50": "FIXT11", "FIX50SP1": "FIXT11", "FIX50SP2": "FIXT11"}
ADMIN_TYPES = ("0", "1", "2", "3", "4", "5", "A", "n")

#: Message types by business bucket, in report order.
BUCKETS = {
    "Session/Admin": "0 1 2 3 4 5 A n",
    "Order Flow": "6 7 8 9 AB AC AF BN BZ CA D DJ DK DS DT E F G H K L M N Q k l m q r s t u",
    "Quotes & Pricing": "AG AH AI AJ CW R S Z a b i",
    "Market Data": "CC CD CE DO DP DR V W X Y",
    "Post-Trade & Allocation": "AD AE AK AQ AR AS AT AU AV BH BM BQ DC DD DU DV DW DX DY DZ EA EB J P T o p",
    "Positions, Collateral & Risk": "AL AM AN AO AP AW AX AY AZ BA BB BG BL BO CH CI CJ CL CM CQ CR CS CT DE DF DG DL DM DN DQ",
    "Reference Data & Definitions": "AA BI BJ BK BP BR BS BT BU BV CF CG CK CN CO CU CV CX CY CZ DA DB c d e f g h v w x y z",
    "Other Business": "B BC BD BE BF BW BX BY C CB DH DI j",
}
OTHER = "Other"

#: Fixed value: fields whose names match hold identifiers that redaction replaces.
SENSITIVE = r"(?i)(CompID|SubID|LocationID|Username|Password|Account)"
