"""The canonical lead schema and the fixed vocabularies that go with it."""

from __future__ import annotations

import re

from pyspark.sql import types as T

# Canonical field -> header keys (lowercase alphanumerics) that mean it.
HEADER_ALIASES: dict[str, tuple[str, ...]] = {
    "name": ("name", "leadname", "customername", "clientname", "fullname", "displayname"),
    "email": ("email", "emailaddress", "emailid"),
    "duplicacy_check": ("duplicacycheck", "duplicatecheck", "duplicacy"),
    "phone": ("phone", "phonenumber", "phoneno", "mobile", "mobilenumber", "contactnumber", "whatsappnumber"),
    "stage": ("stage", "leadstage", "status"),
    "lead_source": ("leadsource", "source"),
    "form": ("form", "facebookform"),
    "form_2": ("form1", "form2"),
    "date": ("date", "datecreated", "createdat", "createddate", "received", "leaddate"),
    "first_call_date": ("firstcalldate", "firstcall"),
    "latest_call_date": ("latestcalldate", "lastcalldate", "latestcall"),
    "call_status": ("callstatus", "latestcallstatus", "lastcallstatus", "latesttcallstatus"),
    "visit_status": ("visitstatus", "sitevisitstatus", "visit"),
    "buying_status": ("buyingstatus", "buyerstatus"),
    "interest_level": ("interestlevel", "interest"),
    "budget": ("budget", "budgetrange"),
    "purpose_of_buying": ("purposeofbuying", "buyingpurpose", "purpose"),
    "configuration_required": (
        "configurationrequired", "configurationrequirement", "configuration", "config",
        "bhkrequired", "configurationneeded", "configneeded",
    ),
    "size_preference": ("sizepreference", "sizerequirement", "sizepreferred"),
    "location_preference": ("locationpreference", "preferredlocation"),
    "qualitative_remarks": ("qualitativeremarks", "remarks", "remark", "comments", "notes"),
    "follow_up_date": ("followupdate", "followup", "nextfollowupdate"),
    "business_profile": ("businessprofile", "profession", "occupation"),
    "hwc": ("hwc", "highqualitypositive"),
    "client_status": ("clientstatus", "clientstatusnote"),
    "assigned_to": ("assignedto", "salesperson", "owner"),
    "properties_seen": ("propertiesseen", "propertyseen", "projectsseen"),
    "current_location": ("currentlocationiffromahmedabad", "currentlocation", "currentarea"),
    "marital_status": ("maritalstatus", "marital"),
    "kids": ("kids", "children", "noofkids"),
    "family_size": ("familysize", "familymembers", "nooffamilymembers"),
    "looking_since": ("lookingsince", "searchingsince"),
    "current_size": ("currentsize", "currenthomesize", "currentconfiguration"),
    "reason_for_shifting": ("reasonforshifting", "shiftingreason", "reasonofshifting"),
    "current_city": ("currentcity", "city"),
    "company_name": ("companyname", "company"),
    "job_title": ("jobtitle",),
    "lead_for_project": ("leadforproject", "project", "projectname"),
    "campaign": ("campaign", "campaignname", "utmcampaign", "facebookcampaign"),
    "facebook_page": ("facebookpage",),
    "facebook_ad_set": ("facebookadset",),
    "facebook_ad": ("facebookad",),
    "opportunity_size": ("opportunitysizers", "opportunitysize", "dealsize", "dealvalue"),
    "total_activities": ("totalactivities", "activities"),
    "last_activity": ("lastactivity", "lastactivitydate"),
    "first_response_mins": ("firstresponsemins", "firstresponse", "firstresponsetime"),
    "groups": ("groups", "group", "tags"),
    "visit_date": ("visitdate", "confimedvisitdate", "confirmedvisitdate"),
}

CANONICAL_FIELDS: tuple[str, ...] = tuple(HEADER_ALIASES)


def header_key(header: str) -> str:
    """The spelling-independent key of a header or label."""
    return re.sub(r"[^a-z0-9]", "", str(header).lower())


def alias_lookup(aliases: dict[str, tuple[str, ...]]) -> dict[str, str]:
    """Invert an alias table; a key claimed by two fields is an error."""
    lookup: dict[str, str] = {}
    for field, keys in aliases.items():
        for key in keys:
            if lookup.setdefault(key, field) != field:
                raise ValueError(f"header key {key!r} is claimed by {lookup[key]!r} and {field!r}")
    return lookup


KEY_TO_FIELD: dict[str, str] = alias_lookup(HEADER_ALIASES)

# Columns this library adds around the canonical fields.
ROW_ORD = "row_ord"
UPLOAD_ID = "upload_id"
SOURCE_FILE = "source_file"
SOURCE_SHEET = "source_sheet"
PROPERTY_TYPE = "property_type"
PROJECT = "project"
EXTRAS = "extras"
HAS_CAMPAIGN = "has_campaign"
NOTE_FIELDS = "note_fields"
PHONE_NORM = "phone_normalized"
MERGED_COUNT = "merged_row_count"
MERGED_SOURCES = "merged_sources"
MEMBER_FRAMES = "member_frames"
LEAD_CLASS = "lead_class"
LEAD_REASON = "lead_class_reason"
NOTE_PREFIX = "note:"

STRING_MAP = T.MapType(T.StringType(), T.StringType())

# One row per lead line, before any merging.
LEAD_ROW_SCHEMA = T.StructType(
    [T.StructField(ROW_ORD, T.LongType())]
    + [T.StructField(c, T.StringType()) for c in (SOURCE_FILE, SOURCE_SHEET, PROPERTY_TYPE, PROJECT)]
    + [T.StructField(c, T.StringType()) for c in CANONICAL_FIELDS]
    + [T.StructField(EXTRAS, STRING_MAP), T.StructField(NOTE_FIELDS, STRING_MAP)]
)
