"""The derived lead table every registered query reads.

The driver's tables hold no leads, so one dirty lead row is derived per order:
the customer is the person, three "files" repeat them, two customers share each
phone, and most cells carry the kind of damage real exports carry.  The same
text runs on Spark and on DuckDB; only the two date-format calls differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leadbook.runtime import stage

_TEMPLATE = """
SELECT o_orderkey AS row_ord,
  CASE o_orderkey % 3 WHEN 0 THEN 'Apartment Leads.csv' WHEN 1 THEN 'crm_a.csv' ELSE 'Bungalow Enquiries.csv' END AS source_file,
  concat('Sheet', cast(o_orderkey % 2 + 1 AS string)) AS source_sheet,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE concat('Camp ', c_mktsegment) END AS campaign,
  CASE o_orderkey % 5 WHEN 0 THEN concat('Mr. ', nm) WHEN 1 THEN upper(nm) WHEN 3 THEN NULL ELSE nm END AS name,
  CASE o_orderkey % 11 WHEN 0 THEN concat('+91', ph) WHEN 1 THEN concat('0', ph) WHEN 2 THEN concat(ph, '.0')
    WHEN 3 THEN concat(ph, ', 9824039892') WHEN 4 THEN concat('+910', ph) WHEN 5 THEN concat('+1', ph)
    WHEN 6 THEN NULL WHEN 7 THEN '#REF!' WHEN 8 THEN '1524279386' ELSE ph END AS phone,
  CASE o_orderkey % 9 WHEN 2 THEN concat(cast(cast(floor(o_totalprice / 1000) AS bigint) AS string), ' L')
    WHEN 3 THEN concat(cast(o_orderkey % 13 AS string), ' Cr') WHEN 4 THEN '1 Cr - 2 Cr' WHEN 5 THEN '80-90 lakhs'
    WHEN 6 THEN '2.5cr' WHEN 7 THEN '75,00,000' WHEN 8 THEN 'inr_4_cr_to_6_cr' ELSE NULL END AS budget,
  CASE o_orderkey % 8 WHEN 0 THEN '3 BHK' WHEN 1 THEN '4bhk' WHEN 2 THEN '4 K' WHEN 3 THEN 'Bungalow only'
    WHEN 4 THEN '4 BHK , 5 BHK' WHEN 5 THEN 'Bungalows, Villa' ELSE NULL END AS configuration_required,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'Spoken' WHEN '2-HIGH' THEN 'Call Back Later' WHEN '3-MEDIUM' THEN 'call back later'
    WHEN '4-NOT SPECIFIED' THEN 'N/A' ELSE 'Not spoken ' END AS call_status,
  CASE WHEN o_orderkey % 6 = 0 THEN NULL WHEN o_orderstatus = 'F' THEN 'Not intrested' WHEN o_orderstatus = 'O' THEN 'Interested' ELSE 'Postponed for now' END AS buying_status,
  CASE WHEN o_orderkey % 10 = 0 THEN 'VIP' WHEN o_orderkey % 10 = 1 THEN '-' ELSE NULL END AS hwc,
  CASE WHEN o_orderkey % 17 = 0 THEN 'Hot lead' ELSE NULL END AS client_status,
  CASE WHEN o_orderkey % 4 = 2 THEN concat(lower(replace(nm, ' ', '.')), '@Example.com') ELSE NULL END AS email,
  CASE o_orderkey % 5 WHEN 0 THEN 'Hot' WHEN 1 THEN 'Cold' WHEN 2 THEN 'warm' WHEN 3 THEN 'Follow Up' ELSE NULL END AS interest_level,
  CASE WHEN o_orderkey % 3 = 1 THEN concat('Page ', cast(o_custkey % 12 AS string)) ELSE NULL END AS facebook_page,
  CASE WHEN o_orderkey % 3 = 1 THEN concat('Set ', cast(o_orderkey % 20 AS string)) ELSE NULL END AS facebook_ad_set,
  CASE o_orderkey % 4 WHEN 0 THEN ' Skyline Heights ' WHEN 1 THEN '  ' ELSE NULL END AS lead_for_project,
  CASE WHEN o_orderkey % 2 = 0 THEN n_name ELSE NULL END AS current_city,
  CASE WHEN o_orderkey % 3 = 2 THEN {iso} ELSE NULL END AS first_call_date,
  CASE o_orderkey % 3 WHEN 0 THEN concat({iso}, ' - ', lpad(cast(o_orderkey % 24 AS string), 2, '0'), ':30') WHEN 1 THEN {dmy} ELSE NULL END AS date,
  CASE WHEN o_orderkey % 4 = 0 THEN concat('City: ', n_name, chr(10), 'What Is Your Budget?: inr_', cast(o_orderkey % 6 + 1 AS string), '_cr', chr(10), 'Timeline: ', cast(o_orderkey % 5 AS string), '_months')
    WHEN o_orderkey % 4 = 1 THEN 'called at 5:30' ELSE NULL END AS qualitative_remarks
FROM (SELECT *, concat(CASE o_custkey % 5 WHEN 0 THEN 'Amit' WHEN 1 THEN 'Priya' WHEN 2 THEN 'Rahul' WHEN 3 THEN 'Sneha' ELSE 'Karan' END, ' ',
   CASE o_custkey % 4 WHEN 0 THEN 'Patel' WHEN 1 THEN 'Shah' WHEN 2 THEN 'Mehta' ELSE 'Desai' END) AS nm,
   concat('98', lpad(cast(cast(floor(o_custkey / 2) AS bigint) AS string), 8, '0')) AS ph
 FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey) x
"""

SPARK_ISO = "date_format(o_orderdate,'yyyy-MM-dd')"
SPARK_DMY = "date_format(o_orderdate,'d-MMM-yy')"
DUCK_ISO = "strftime(o_orderdate,'%Y-%m-%d')"
DUCK_DMY = "strftime(o_orderdate,'%-d-%b-%y')"


def duck_lead_export() -> str:
    """The DuckDB form, over the pre-registered views."""
    return _TEMPLATE.format(
        iso=DUCK_ISO, dmy=DUCK_DMY, orders="orders", customer="customer", nation="nation"
    ).strip()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derive_lead_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Spark form, as a plan over orders, customer and nation."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    text = _TEMPLATE.format(
        iso=SPARK_ISO, dmy=SPARK_DMY, orders="{orders}", customer="{customer}", nation="{nation}"
    )
    return spark.sql(
        text,
        orders=table(spark, sf_dir, "orders"),
        customer=table(spark, sf_dir, "customer"),
        nation=table(spark, sf_dir, "nation"),
    )


_STORED: dict[tuple[str, str], DataFrame] = {}


def lead_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived rows as a stored table, as leads are kept; written once per session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORED:
        _STORED[key] = stage(derive_lead_export(spark, sf_dir), "lead_export", rows_per_file=20_000)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return _STORED[key]
