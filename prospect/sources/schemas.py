"""Explicit schemas for every raw source and prepared table.

Raw reads never infer types (inference costs a full extra pass over the
input and guesses dates wrongly), so each reader takes one of these.
"""

from __future__ import annotations

from pyspark.sql import types as T

S, I, L, D, DT, B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.DateType(), T.BooleanType()

# Company CSV: only the fields the pipeline uses, named as in the file header.
COMPANY_CSV_FIELDS = [
    ("CompanyName", S),
    ("CompanyNumber", S),
    ("RegAddress.PostCode", S),
    ("CompanyCategory", S),
    ("CompanyStatus", S),
    ("CountryOfOrigin", S),
    ("IncorporationDate", DT),
    ("Accounts.AccountCategory", S),
    ("Accounts.NextDueDate", DT),
    ("Accounts.LastMadeUpDate", DT),
    ("ConfStmtNextDueDate", DT),
    ("ConfStmtLastMadeUpDate", DT),
    ("SICCode.SicText_1", S),
    ("SICCode.SicText_2", S),
    ("SICCode.SicText_3", S),
    ("SICCode.SicText_4", S),
]
COMPANY_CSV = T.StructType([T.StructField(n, t, True) for n, t in COMPANY_CSV_FIELDS])
SIC_TEXT_COLUMNS = [f"SICCode.SicText_{i}" for i in range(1, 5)]

# Postcode directory CSV (the used fields).
POSTCODE_CSV = T.StructType([
    T.StructField("pcds", S), T.StructField("lat", D), T.StructField("long", D),
    T.StructField("lsoa21", S), T.StructField("doterm", S),
])

# Owner ("persons with significant control") NDJSON record.
PSC_JSON = T.StructType([
    T.StructField("company_number", S),
    T.StructField("data", T.StructType([
        T.StructField("name", S),
        T.StructField("kind", S),
        T.StructField("date_of_birth", T.StructType([T.StructField("year", L), T.StructField("month", L)])),
        T.StructField("nationality", S),
        T.StructField("natures_of_control", T.ArrayType(S)),
        T.StructField("notified_on", DT),
        # Text: any value, readable as a date or not, means the owner has ceased.
        T.StructField("ceased_on", S),
    ])),
])
CORRUPT_COLUMN = "_corrupt_record"
PSC_JSON_WITH_CORRUPT = T.StructType(PSC_JSON.fields + [T.StructField(CORRUPT_COLUMN, S)])

# Prepared tables.
COMPANIES = T.StructType([
    T.StructField("CompanyNumber", S), T.StructField("CompanyName", S),
    T.StructField("RegAddressPostCode", S), T.StructField("CompanyStatus", S),
    T.StructField("CompanyCategory", S), T.StructField("CountryOfOrigin", S),
    T.StructField("IncorporationDate", DT), T.StructField("AccountCategory", S),
    T.StructField("AccountsNextDueDate", DT), T.StructField("AccountsLastMadeUpDate", DT),
    T.StructField("ConfStmtNextDueDate", DT), T.StructField("ConfStmtLastMadeUpDate", DT),
])
COMPANY_SIC = T.StructType([
    T.StructField("CompanyNumber", S), T.StructField("sic_code", I),
    T.StructField("sic_description", S), T.StructField("sic_position", I),
])
POSTCODES = T.StructType([
    T.StructField("pcds", S), T.StructField("lat", D), T.StructField("long", D), T.StructField("lsoa21", S),
])
PSC = T.StructType([
    T.StructField("company_number", S), T.StructField("name", S), T.StructField("kind", S),
    T.StructField("birth_year", I), T.StructField("approximate_age", I), T.StructField("nationality", S),
    T.StructField("natures_of_control", T.ArrayType(S)), T.StructField("notified_on", DT),
])
OFFICERS = T.StructType([T.StructField("company_number", S), T.StructField("appointment_date", L)])

# One search request (batch form).  NULL means "not given".
REQUESTS = T.StructType([
    T.StructField("request_id", S),
    T.StructField("postcode", S),
    T.StructField("radius_miles", D),
    T.StructField("company_status", S),
    T.StructField("account_categories", T.ArrayType(S)),
    T.StructField("sic_codes", T.ArrayType(L)),
    T.StructField("min_company_age_years", I),
    T.StructField("max_company_age_years", I),
    T.StructField("min_psc_age", I),
    T.StructField("max_psc_age", I),
    T.StructField("min_psc_tenure_years", I),
    T.StructField("max_psc_tenure_years", I),
    T.StructField("strict_psc_tenure", B),
    T.StructField("output_format", S),
    T.StructField("max_results", I),
])
REQUEST_FIELDS = [f.name for f in REQUESTS.fields if f.name != "request_id"]
