"""Raw tables of the large primary-care schema; names and codes are fixed values."""

from __future__ import annotations

import datetime

from ...functions.codes import DMDCode
from ...functions.constraints import Constraint
from ...language import EventFrame, Series, table
from .._parts import add_columns, needed, one_of
from . import core

__all__ = ["apcs_cost_historical", "apcs_historical", "isaric", "medications", "ons_deaths", "repeat_medications", "wl_clockstops", "wl_openpathways"]


class _Spell(EventFrame):
    apcs_ident = needed(int)
    admission_date = Series(datetime.date)
    discharge_date = Series(datetime.date)


@table
class apcs_historical(_Spell):
    spell_core_hrg_sus = Series(str)


@table
class apcs_cost_historical(_Spell):
    grand_total_payment_mff = Series(float)
    tariff_initial_amount = Series(float)
    tariff_total_payment = Series(float)


class _Study(EventFrame):
    diabetes_type_mhyn = one_of("NO", "1", "2", "N/K")
    smoking_mhyn = one_of("Yes", "Never Smoked", "Former Smoker", "N/K")


#: Conditions that the study's form asks for.
ASKED = (
    "chrincard", "hypertension_mhyn", "chronicpul_mhyn", "asthma_mhyn", "renal_mhyn", "mildliver", "modliv", "chronicneu_mhyn", "malignantneo_mhyn", "chronichaemo_mhyn", "aidshiv_mhyn", "obesity_mhyn",
    "diabetescom_mhyn", "diabetes_mhyn", "rheumatologic_mhyn", "dementia_mhyn", "malnutrition_mhyn",
)
for _name in ASKED:
    add_columns(_Study, [_name], one_of("YES", "NO", "Unknown"))
add_columns(_Study, ("age", "age_factor", "calc_age", "sex", *(f"ethnic___{i}" for i in range(1, 11))), str)
add_columns(_Study, ("covid19_vaccine", "covid19_vaccined_nk", "corona_ieorres", "coriona_ieorres2", "coriona_ieorres3", "inflammatory_mss", "hooccur", "hostdat_transfernk", "readm_cov19"), str)
add_columns(_Study, ("covid19_vaccined", "covid19_vaccine2d", "cestdat", "hostdat", "hostdat_transfer", "dsstdat", "dsstdtc"), datetime.date)


@table
class isaric(_Study):
    class _meta:
        table_name = "isaric_raw"
        required_permission = "isaric"


class _Issue(EventFrame):
    date = Series(datetime.date)
    dmd_code = Series(DMDCode)
    consultation_id = Series(int)
    medication_status = Series(int, constraints=[Constraint.ClosedRange(0, 28)])
    quantity = Series(str)
    repeat_medication_id = Series(int)


@table
class medications(_Issue):
    class _meta:
        table_name = "medications_raw"
        activation_filter_field = "date"


@table
class repeat_medications(_Issue):
    class _meta:
        table_name = "repeat_medications_raw"
        activation_filter_field = "date"

    start_date = Series(datetime.date)
    end_date = Series(datetime.date)


@table
class ons_deaths(type(core.ons_deaths)):
    class _meta:
        table_name = "ons_deaths_raw"

    place = one_of("Care Home", "Elsewhere", "Home", "Hospice", "Hospital", "Other communal establishment")


class _Pathway(EventFrame):
    """Dates are kept as they were written."""


PATHWAY = (
    "activity_treatment_function_code", "priority_type_code", "pseudo_organisation_code_patient_pathway_identifier_issuer", "pseudo_patient_pathway_identifier", "pseudo_referral_identifier",
    "referral_request_received_date", "referral_to_treatment_period_end_date", "referral_to_treatment_period_start_date", "waiting_list_type", "week_ending_date",
)
add_columns(_Pathway, PATHWAY, str)


@table
class wl_clockstops(_Pathway):
    class _meta:
        table_name = "wl_clockstops_raw"
        required_permission = "waiting_list"

    source_of_referral_for_outpatients = Series(str)


@table
class wl_openpathways(_Pathway):
    class _meta:
        table_name = "wl_openpathways_raw"
        required_permission = "waiting_list"

    current_pathway_period_start_date = Series(str)
    source_of_referral = Series(str)
