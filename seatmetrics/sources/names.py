"""What exports call their columns: normalized names by dataset, by field, and by the licence manager that wrote the file."""

from __future__ import annotations

# Normalized column names of each field of usage exports, whoever wrote them.
USAGE = {
    "date": "date usage_date day log_date event_date report_date activity_date calendar_date",
    "hour": "hour hour_of_day hr time_bucket interval bucket",
    "observed_at": "timestamp datetime date_time event_time observed_at time_stamp sample_time",
    "user": "user username user_name userid user_id login login_name network_id network_user account account_name",
    "employee_code": "employee_id employeeid emp_id empl_id badge personnel_number worker_id",
    "feature": "feature feature_name license_feature lic_feature module featurename",
    "product": "product product_name application app app_name software title",
    "vendor": "vendor publisher supplier manufacturer vendor_name",
    "quantity": "quantity qty count num_licenses licenses requested checkouts checkout_count usage_count sessions session_count",
    "concurrent": "licenses_in_use licences_in_use licenses_checked_out in_use_count concurrent in_use inuse used licenses_used checked_out current_usage active",
    "peak": "peak peak_usage max_concurrent max_used high_water maximum_used peak_concurrent",
    "available": "available total capacity issued total_licenses licenses_available free",
    "duration_hours": "duration duration_hours hours usage_hours license_hours elapsed elapsed_hours runtime",
    "checkout_at": "checkout checkout_time check_out start_time acquired out_time",
    "checkin_at": "checkin checkin_time check_in end_time released in_time",
    "denied": "denied denial is_denied rejected status",
    "denial_count": "denials denial_count denied_count rejections queued",
    "license_server": "license_server lic_server server_host server_name license_host",
    "pool": "pool license_pool server_group cluster site",
    "tokens": "tokens token_count token_usage tokens_used credits",
    "hostname": "hostname host host_name client_host client_hostname machine machine_name workstation display client",
    "version": "version feature_version lic_version product_version ver release",
    "borrowed": "borrowed is_borrowed borrow roaming is_roaming linger offline",
}
# The same for entitlements.
ENTITLEMENTS = {
    "feature": "feature feature_name license_feature module featurename",
    "product": "product product_name application software title",
    "vendor": "vendor publisher supplier manufacturer vendor_name",
    "quantity": "quantity qty entitled entitled_quantity seats licenses count total_licenses max max_licenses num_licenses capacity",
    "license_model": "license_model license_type model type metric licensing_model",
    "license_server": "license_server lic_server server_host server_name license_host",
    "pool": "pool license_pool server_group cluster site",
    "expires_on": "expires expiry expiration expiration_date expires_on end_date valid_until renewal_date",
}
# The same for directories of people.
PEOPLE = {
    "user": "user username user_name login login_name network_id network_user networkid userid user_id sam_account samaccountname account ntid",
    "employee_code": "employee_id employeeid emp_id empl_id badge badge_number personnel_number worker_id person_number staff_id",
    "display_name": "name full_name fullname display_name employee_name person preferred_name",
    "email": "email email_address mail work_email primary_email upn",
    "status": "status employment_status worker_status active employee_status",
    "employee_type": "employment_type worker_type employee_type contract_type staff_type",
    "manager_name": "manager manager_name supervisor reports_to line_manager",
    "manager_key": "manager_id manager_email managerid supervisor_id supervisor_email reports_to_id manager_employee_id",
    "department": "department dept department_name org_unit organizational_unit",
    "organization": "organization organisation org company legal_entity",
    "business_unit": "business_unit bu division sector segment",
    "program": "program programme project project_name program_name",
    "discipline": "discipline engineering_discipline function job_family specialty",
    "competency": "competency competence capability skill_group practice",
    "location": "location site office work_location facility campus",
    "region": "region geo geography country area",
    "cost_center": "cost_center cost_centre costcenter charge_code gl_code account_code",
}
# The same for contracts; each bare word for money belongs to one field only.
CONTRACTS = {
    "feature": "feature feature_name license_feature module component sku_description item_description line_description description line_item item",
    "product": "product product_name application software tool software_name title",
    "vendor": "vendor publisher manufacturer software_vendor vendor_name oem brand",
    "sku": "sku part_number part_no partno item_number item_code product_code material material_number catalog_number",
    "contract_number": "contract contract_number contract_no contract_id contract_ref contract_reference",
    "agreement_number": "agreement agreement_number agreement_no master_agreement enterprise_agreement ela",
    "purchase_order": "po po_number po_no purchase_order purchase_order_number",
    "supplier": "supplier reseller distributor partner sold_by",
    "quantity": "qty quantity seats licenses licences owned entitled entitlement_qty units seat_count volume number_of_licenses",
    "unit_price": "unit_price price price_each cost_per_license per_seat_cost unit_cost unit_list_price list_price net_price price_per_unit price_per_seat rate",
    "total_cost": "total total_cost total_price extended_cost extended_price contract_value line_total cost amount net_amount",
    "annual_cost": "annual_cost annual_spend yearly_cost annualized_cost annualised_cost annual_price annual_value cost_per_year spend",
    "currency": "currency currency_code ccy curr",
    "license_model": "license_model license_type licensing_model license_metric model metric",
    "pricing_unit": "pricing_unit unit uom unit_of_measure price_unit",
    "start_date": "start_date contract_start term_start effective_date start",
    "end_date": "end_date contract_end term_end expires_on end",
    "renewal_date": "renewal_date renewal next_renewal expiration_date expiry_date expiration expiry expires renews_on renew_by",
    "business_unit": "business_unit division department bu",
    "cost_center": "cost_center cost_centre charge_code gl_code account_code cc",
    "owner": "owner business_owner responsible requestor contact",
    "notes": "notes note comment comments remarks",
}
NAMES = {"usage": USAGE, "entitlements": ENTITLEMENTS, "people": PEOPLE, "contracts": CONTRACTS}

# What one licence manager calls the fields of its usage exports besides.
FLEXNET = {
    "user": "flex_user lm_user checkout_user user_name display_user",
    "feature": "feature feature_name lic_feature flex_feature",
    "vendor": "vendor_daemon vendordaemon daemon isv",
    "license_server": "server_host license_host lmgrd_host flex_server",
    "hostname": "host display client_host client_hostname workstation node",
    "version": "feature_version version lic_version ver",
    "borrowed": "borrowed is_borrowed linger borrow_expiration roaming",
    "pool": "license_pool server_group triad",
    "checkout_at": "checkout_time out_time start",
    "checkin_at": "checkin_time in_time stop return_time",
    "concurrent": "licenses_in_use in_use_count users_current",
    "available": "licenses_issued issued users_total total_licenses",
    "denied": "denied denial status",
    "denial_count": "denials denial_count num_denied",
    "duration_hours": "duration_hours usage_hours elapsed_hours",
    "tokens": "tokens token_count",
    "quantity": "num_lic numlic licenses_requested checkouts",
}
RLM = {
    "user": "rlm_user user user_name login_name",
    "feature": "product feature rlm_product license_name",
    "vendor": "isv isv_name rlm_isv vendor",
    "license_server": "rlm_server server_host license_host isv_server",
    "pool": "pool license_pool rlm_pool",
    "concurrent": "count_in_use in_use current_use inuse_count",
    "available": "count total_count licenses_available pool_count",
    "checkout_at": "checkout_time out_time start_time",
    "checkin_at": "checkin_time in_time end_time",
    "denial_count": "denials denied_count denial_count",
    "denied": "denied status result",
    "quantity": "count_requested num_requested checkouts",
    "duration_hours": "duration_hours hours_used elapsed_hours",
    "hostname": "host client_host hostname requesting_host machine",
    "version": "ver version product_version license_version",
    "borrowed": "roaming is_roaming roam borrowed",
    "employee_code": "employee_id emp_id",
}
DSLS = {
    "user": "user_id userid dsls_user user_name login",
    "feature": "license_name feature dsls_feature license_id model_name",
    "product": "product_line product application brand",
    "vendor": "vendor publisher editor",
    "license_server": "server_id dsls_server license_server server_name",
    "concurrent": "in_use inuse_count used_count current_usage",
    "available": "max_count total_count license_count max",
    "tokens": "token tokens token_count token_weight credits",
    "checkout_at": "acquire_time checkout_time start_time grant_time",
    "checkin_at": "release_time checkin_time end_time",
    "denial_count": "denied_count denials refused_count",
    "denied": "denied refused status",
    "duration_hours": "duration_hours usage_duration elapsed_hours",
    "quantity": "requested_count count checkouts",
    "pool": "pool license_pool site_id",
    "hostname": "client_host host hostname machine machine_name client_machine",
    "version": "license_version version release product_version level",
    "borrowed": "offline is_offline borrowed offline_mode",
    "employee_code": "customer_id employee_id",
}
SENTINEL = {
    "user": "client_user client_username user_name sentinel_user user",
    "feature": "feature_name feature feature_id license_feature",
    "product": "product application product_name",
    "vendor": "vendor publisher",
    "license_server": "license_server lserv_host server_name sentinel_server",
    "concurrent": "licenses_in_use in_use used_licenses current_users",
    "available": "total_licenses license_count max_users capacity",
    "peak": "peak_usage max_in_use highest_usage peak_users",
    "denial_count": "denied_requests denials rejected_count",
    "denied": "denied status result",
    "observed_at": "sample_time poll_time snapshot_time timestamp",
    "pool": "pool sublicense sub_license",
    "duration_hours": "duration_hours usage_hours",
    "quantity": "requested checkouts count",
    "version": "feature_version version ver feature_ver",
    "hostname": "client_host client_hostname host machine workstation",
    "borrowed": "commuter is_commuter borrowed checked_out_offline",
}
# The same for their entitlement and people exports.
FLEXNET_OTHER = {
    "entitlements": {
        "feature": "feature feature_name lic_feature",
        "vendor": "vendor_daemon daemon isv",
        "quantity": "licenses_issued issued num_lic users_total count",
        "expires_on": "expiry_date exp_date expiration",
        "license_server": "server_host license_host flex_server",
        "license_model": "license_type lic_type model",
    },
    "people": {"user": "flex_user lm_user user_name"},
}
RLM_OTHER = {
    "entitlements": {
        "feature": "product feature license_name",
        "vendor": "isv isv_name vendor",
        "quantity": "count total_count pool_count licenses",
        "expires_on": "exp exp_date expiration_date expires",
        "license_server": "rlm_server server_host isv_server",
        "license_model": "type license_type model",
        "pool": "pool license_pool",
    },
    "people": {"user": "rlm_user user user_name"},
}
DSLS_OTHER = {
    "entitlements": {
        "feature": "license_name feature license_id model_name",
        "product": "product_line product brand",
        "quantity": "max_count license_count total_count max quantity",
        "license_model": "license_type model type usage_type",
        "expires_on": "expiration_date end_date expiry_date valid_until",
        "license_server": "server_id dsls_server license_server",
        "pool": "pool site_id",
    },
    "people": {"user": "user_id dsls_user user_name", "employee_code": "customer_id employee_id"},
}
SENTINEL_OTHER = {
    "entitlements": {
        "feature": "feature_name feature feature_id",
        "product": "product application",
        "quantity": "total_licenses license_count max_users num_licenses capacity",
        "license_model": "license_type type model",
        "expires_on": "expiration_date expiry_date end_date valid_until",
        "license_server": "license_server lserv_host sentinel_server server_name",
        "pool": "sublicense sub_license pool",
    },
    "people": {"user": "client_user client_username sentinel_user user_name"},
}
SOURCES = {
    "flexnet": {"usage": FLEXNET, **FLEXNET_OTHER},
    "rlm": {"usage": RLM, **RLM_OTHER},
    "dsls": {"usage": DSLS, **DSLS_OTHER},
    "sentinel": {"usage": SENTINEL, **SENTINEL_OTHER},
}


def of_field(dataset: str, field: str) -> tuple[str, ...]:
    return tuple(NAMES[dataset].get(field, "").split())


def of_source(source: str, dataset: str, field: str) -> tuple[str, ...]:
    return tuple(SOURCES.get(source, {}).get(dataset, {}).get(field, "").split())
