"""Declared schemas of the raw tables; nothing is ever inferred."""

from pyspark.sql import types as T

# Column names and types of the seven raw tables.
CUSTOMER = "customer_id string, first_name string, last_name string, customer_type string, tax_id string, date_of_birth date, email string, phone string, address string, created_at timestamp_ntz"
ACCOUNT = "account_id string, customer_id string, account_type string, account_number string, branch_code string, balance decimal(15,2), status string, opened_date date, created_at timestamp_ntz"
TRANSACTION = "transaction_id string, account_id string, transaction_type string, amount decimal(12,2), business_date date, memo string, created_at timestamp_ntz"
LOAN = "loan_id string, customer_id string, account_id string, loan_type string, principal decimal(15,2), interest_rate decimal(5,2), credit_grade string, collateral_value decimal(15,2), loan_memo string, status string, origination_date date, created_at timestamp_ntz"
GL_CONTROL = "gl_code string, account_type string, control_total decimal(15,2), record_count int, as_of_date date"
BRANCH = "branch_code string, branch_name string, branch_manager string, region string"
PRODUCT = "product_code string, product_name string, account_type string, tier string"
DICTIONARY = "table_name string, column_name string, column_description string, data_type string, sensitivity_classification string, is_cde string, notes string"

RAW_TABLES = {
    "customer": CUSTOMER,
    "account": ACCOUNT,
    "transaction": TRANSACTION,
    "loan": LOAN,
    "gl_control": GL_CONTROL,
    "branch": BRANCH,
    "product": PRODUCT,
}

# Names of the sealed truth set's two sections and its JSON fields.
SEALED = (
    "confirmed_sensitive_columns array<struct<table:string,column:string,classification:string,reason:string>>, "
    "deliberately_mislabeled array<struct<table:string,column:string,actual_classification:string,why_mislabeled:string>>"
)


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
