"""Schemas with the edges that must be found: name(columns; * marks a declared key) -> edges."""

SCHEMAS = {
    "star": ("dim_customer(customer_key NUMBER*, customer_name STRING, customer_segment STRING) dim_product(product_key NUMBER*, product_name STRING, category STRING) dim_date(date_key NUMBER*, calendar_date DATE, fiscal_week NUMBER) fact_orders(order_id NUMBER*, order_date_key NUMBER, customer_key NUMBER, product_key NUMBER, order_amount NUMBER)", "fact_orders>dim_customer fact_orders>dim_date fact_orders>dim_product", 0.6),
    "tpch": ("customer(c_custkey NUMBER*, c_nationkey NUMBER) orders(o_orderkey NUMBER*, o_custkey NUMBER) lineitem(l_orderkey NUMBER*, l_linenumber NUMBER*, l_partkey NUMBER, l_suppkey NUMBER) part(p_partkey NUMBER*) supplier(s_suppkey NUMBER*, s_nationkey NUMBER) nation(n_nationkey NUMBER*, n_regionkey NUMBER) region(r_regionkey NUMBER*)", "customer>nation lineitem>orders lineitem>part lineitem>supplier nation>region orders>customer supplier>nation", 0.6),
    "bridge": ("orders(order_id NUMBER*, customer_id NUMBER) products(product_id NUMBER*, sku STRING) order_items(order_id NUMBER*, product_id NUMBER*, quantity NUMBER)", "order_items>orders order_items>products", 0.6),
    "hub_and_spoke": ("dim_customer(customer_key NUMBER*, current_address_key NUMBER) dim_customer_attributes(customer_key NUMBER*, email STRING, phone STRING) dim_customer_address(address_key NUMBER*, street STRING, city STRING) fact_subscription(subscription_id NUMBER*, customer_key NUMBER, start_date_key NUMBER) dim_date(date_key NUMBER*, calendar_date DATE)", "dim_customer>dim_customer_address dim_customer>dim_customer_attributes fact_subscription>dim_customer fact_subscription>dim_date", 0.6),
    "crm": ("accounts(account_id STRING*, parent_account_id STRING) opportunities(opportunity_id STRING*, account_id STRING, owner_user_id STRING) contacts(contact_id STRING*, account_id STRING, owner_user_id STRING) users(user_id STRING*, manager_id STRING)", "contacts>accounts contacts>users opportunities>accounts opportunities>users !accounts>accounts", 0.5),
    "ledger": ("gl_journal_entry(journal_entry_id NUMBER*, batch_id NUMBER, entered_by_employee_id NUMBER) gl_journal_line(journal_entry_id NUMBER*, journal_line_number NUMBER*, account_id NUMBER, cost_center_id NUMBER) dim_account(account_id NUMBER*, account_type STRING) dim_cost_center(cost_center_id NUMBER*, division STRING) dim_employee(employee_id NUMBER*, manager_employee_id NUMBER)", "gl_journal_entry>dim_employee gl_journal_line>dim_account gl_journal_line>dim_cost_center gl_journal_line>gl_journal_entry", 0.6),
    "shop_floor": ("prod_order(prod_order_id NUMBER*, item_id NUMBER, customer_id NUMBER) work_order(work_order_id NUMBER*, prod_order_id NUMBER, machine_id NUMBER) machine(machine_id NUMBER*, work_center_id NUMBER) work_center(work_center_id NUMBER*, plant_id NUMBER) bom_component(prod_order_id NUMBER*, component_id NUMBER*)", "bom_component>prod_order machine>work_center work_order>machine work_order>prod_order", 0.6),
    "marketing": ("dim_campaign(campaign_id STRING*, channel_id STRING) dim_channel(channel_id STRING*, parent_channel_id STRING) fact_touch(touch_id STRING*, campaign_id STRING, user_id STRING) fact_conversion(conversion_id STRING*, touch_id STRING, user_id STRING) dim_user(user_id STRING*, household_id STRING)", "dim_campaign>dim_channel fact_conversion>dim_user fact_conversion>fact_touch fact_touch>dim_campaign fact_touch>dim_user !fact_conversion>dim_campaign", 0.5),
    "healthcare": ("dim_patient(patient_id STRING*, primary_provider_id STRING) dim_provider(provider_id STRING*, specialty STRING) fact_encounter(encounter_id STRING*, patient_id STRING, attending_provider_id STRING) fact_encounter_diagnosis(encounter_id STRING*, diagnosis_code STRING*) dim_diagnosis(diagnosis_code STRING*, icd_chapter STRING) fact_encounter_procedure(encounter_id STRING*, procedure_code STRING*) dim_procedure(procedure_code STRING*, category STRING)", "fact_encounter>dim_patient fact_encounter>dim_provider fact_encounter_diagnosis>dim_diagnosis fact_encounter_diagnosis>fact_encounter fact_encounter_procedure>dim_procedure fact_encounter_procedure>fact_encounter", 0.5),
    "banking": ("cust_info(cust_id VARCHAR*, cust_name VARCHAR, cust_type VARCHAR, branch_id VARCHAR) branch_info(branch_id VARCHAR*, branch_name VARCHAR, region_id VARCHAR) region_info(region_id VARCHAR*, region_name VARCHAR) account_info(account_id VARCHAR*, cust_id VARCHAR, product_id VARCHAR, account_status VARCHAR, open_date DATE) product_info(product_id VARCHAR*, product_name VARCHAR, product_type VARCHAR) transaction_detail(trans_id VARCHAR*, account_id VARCHAR, trans_type VARCHAR, trans_amount DECIMAL, trans_date TIMESTAMP, counterparty_account_id VARCHAR) cust_account_rel(cust_id VARCHAR*, account_id VARCHAR*, relation_type VARCHAR)", "account_info>cust_info account_info>product_info branch_info>region_info cust_account_rel>account_info cust_account_rel>cust_info cust_info>branch_info transaction_detail>account_info", 0.5),
    "lending": ("user(user_id BIGINT*, mobile VARCHAR, id_card_no VARCHAR, risk_level INT) loan_application(application_id BIGINT*, user_id BIGINT, apply_amount DECIMAL, product_code VARCHAR, application_status VARCHAR, apply_time TIMESTAMP) loan_contract(contract_id BIGINT*, application_id BIGINT, user_id BIGINT, loan_amount DECIMAL, interest_rate DECIMAL, contract_status VARCHAR, sign_time TIMESTAMP) repayment_plan(contract_id BIGINT*, period_no INT*, due_date DATE, due_amount DECIMAL, repayment_status VARCHAR) repayment_record(repayment_id BIGINT*, contract_id BIGINT, period_no INT, repay_amount DECIMAL, repay_time TIMESTAMP) risk_assessment(assessment_id BIGINT*, application_id BIGINT, user_id BIGINT, risk_score INT, assessment_time TIMESTAMP) loan_product(product_code VARCHAR*, product_name VARCHAR, max_amount DECIMAL, min_rate DECIMAL)", "loan_application>loan_product loan_application>user loan_contract>loan_application loan_contract>user repayment_plan>loan_contract repayment_record>loan_contract risk_assessment>loan_application risk_assessment>user", 0.5),
    "payments": ("t_order(order_no VARCHAR*, merchant_no VARCHAR, user_no VARCHAR, amount DECIMAL, create_time TIMESTAMP) t_merchant(merchant_no VARCHAR*, merchant_name VARCHAR, industry_code VARCHAR) t_user_account(user_no VARCHAR*, balance DECIMAL, status INT) t_pay(pay_no VARCHAR*, order_no VARCHAR, channel VARCHAR, pay_amount DECIMAL, pay_time TIMESTAMP) t_channel(channel VARCHAR*, channel_name VARCHAR, fee_rate DECIMAL) t_settlement(settlement_id BIGINT*, merchant_no VARCHAR, settlement_date DATE, settlement_amount DECIMAL) t_settlement_detail(settlement_id BIGINT*, pay_no VARCHAR*, settle_amount DECIMAL)", "t_order>t_merchant t_order>t_user_account t_pay>t_channel t_pay>t_order t_settlement>t_merchant t_settlement_detail>t_pay t_settlement_detail>t_settlement", 0.5),
    "securities": ("trading_account(account_id VARCHAR*, customer_id VARCHAR, account_type VARCHAR, cash_balance DECIMAL) customer(customer_id VARCHAR*, customer_name VARCHAR, id_number VARCHAR) stock_order(order_id VARCHAR*, account_id VARCHAR, stock_code VARCHAR, order_type VARCHAR, order_price DECIMAL, order_qty BIGINT, order_time TIMESTAMP, order_status VARCHAR) stock_info(stock_code VARCHAR*, stock_name VARCHAR, exchange VARCHAR) trade_fill(fill_id VARCHAR*, order_id VARCHAR, fill_price DECIMAL, fill_qty BIGINT, fill_time TIMESTAMP) position(account_id VARCHAR*, stock_code VARCHAR*, position_qty BIGINT, cost_price DECIMAL, market_value DECIMAL) daily_pnl(account_id VARCHAR*, trade_date DATE*, realized_pnl DECIMAL, unrealized_pnl DECIMAL)", "daily_pnl>trading_account position>stock_info position>trading_account stock_order>stock_info stock_order>trading_account trade_fill>stock_order trading_account>customer", 0.5),
    "insurance": ("policy_holder(holder_id VARCHAR*, holder_name VARCHAR, contact_phone VARCHAR) insurance_policy(policy_no VARCHAR*, holder_id VARCHAR, product_code VARCHAR, premium DECIMAL, policy_status VARCHAR, effective_date DATE) insurance_product(product_code VARCHAR*, product_name VARCHAR, insurance_type VARCHAR, coverage_amount DECIMAL) insured_person(insured_id VARCHAR*, insured_name VARCHAR, birth_date DATE) policy_insured_rel(policy_no VARCHAR*, insured_id VARCHAR*, insured_type VARCHAR) claim(claim_no VARCHAR*, policy_no VARCHAR, insured_id VARCHAR, claim_amount DECIMAL, claim_date DATE, claim_status VARCHAR) claim_detail(claim_no VARCHAR*, detail_seq INT*, expense_type VARCHAR, expense_amount DECIMAL) reinsurance_contract(reinsurance_id VARCHAR*, policy_no VARCHAR, reinsurer_code VARCHAR, ceded_premium DECIMAL)", "claim>insurance_policy claim>insured_person claim_detail>claim insurance_policy>insurance_product insurance_policy>policy_holder policy_insured_rel>insurance_policy policy_insured_rel>insured_person reinsurance_contract>insurance_policy", 0.5),
    "retail_no_keys": ("customer(customer_id BIGINT, customer_name VARCHAR, email VARCHAR, register_date DATE) product(product_id BIGINT, product_name VARCHAR, category_id INT, price DECIMAL) category(category_id INT, category_name VARCHAR) orders(order_id BIGINT, customer_id BIGINT, order_date TIMESTAMP, total_amount DECIMAL) order_item(order_id BIGINT, item_seq INT, product_id BIGINT, quantity INT, item_price DECIMAL)", "orders>customer order_item>orders order_item>product product>category", 0.5),
    "partial_keys": ("account(account_no VARCHAR*, customer_id VARCHAR, account_type VARCHAR, balance DECIMAL) customer(customer_id VARCHAR, customer_name VARCHAR, id_number VARCHAR) transaction(trans_id BIGINT*, account_no VARCHAR, trans_amount DECIMAL, trans_time TIMESTAMP) card(card_no VARCHAR, account_no VARCHAR, card_type VARCHAR, expire_date DATE)", "account>customer card>account transaction>account", 0.5),
    "data_lake": ("user_profile(user_id BIGINT, name VARCHAR, phone VARCHAR) order_data(order_id BIGINT, user_id BIGINT, amount DECIMAL, create_time TIMESTAMP) payment_info(pay_id BIGINT, order_id BIGINT, pay_amount DECIMAL, pay_method VARCHAR)", "order_data>user_profile payment_info>order_data", 0.5),
    "composite_no_keys": ("warehouse(warehouse_id VARCHAR, warehouse_name VARCHAR, region VARCHAR) product(product_id VARCHAR, product_name VARCHAR, category VARCHAR) inventory(warehouse_id VARCHAR, product_id VARCHAR, stock_quantity INT, last_update TIMESTAMP) stock_movement(movement_id BIGINT, warehouse_id VARCHAR, product_id VARCHAR, movement_type VARCHAR, quantity INT, movement_date DATE)", "inventory>product inventory>warehouse stock_movement>product stock_movement>warehouse", 0.5),
    "uuid_keys": ("user(user_id VARCHAR, username VARCHAR, email VARCHAR) post(post_id VARCHAR, user_id VARCHAR, title VARCHAR, content TEXT, created_at TIMESTAMP) comment(comment_id VARCHAR, post_id VARCHAR, user_id VARCHAR, content TEXT, created_at TIMESTAMP) post_like(user_id VARCHAR, post_id VARCHAR, created_at TIMESTAMP)", "comment>post comment>user post>user post_like>post post_like>user", 0.5),
    "poor_names": ("usr(uid BIGINT, nm VARCHAR) ord(oid BIGINT, uid BIGINT, amt DECIMAL)", "", 0.5),
    "poor_names_with_values": ("usr(uid BIGINT=1..25, nm VARCHAR) ord(oid BIGINT=101..125, uid BIGINT=1/2/1/3/2/1/4/3/5/2/6/1/7/8/2/9/1/10/11/3/12/4/13/2/14, amt DECIMAL) pay(pid BIGINT=201..225, oid BIGINT=101/102/103/101/104/105/101/106/107/102/108/109/110/103/111/112/113/104/114/115/116/105/117/118/119, method VARCHAR)", "ord>usr pay>ord", 0.5),
    "composite_with_values": ("store(sid INT=1/1/1/2/2/2/3/3/3/4/4/4/5/5/5/6/6/6/7/7, store_name VARCHAR) product(pid INT=101..120, product_name VARCHAR) inventory(sid INT=1/1/1/2/2/2/3/3/3/4/4/4/5/5/5/6/6/6/7/7, pid INT=101/102/103/101/102/103/101/102/103/101/102/103/101/102/103/101/102/103/101/102, qty INT)", "inventory>product inventory>store", 0.5),
}


def definitions(text: str) -> list[dict]:
    import re

    out = []
    for name, body in re.findall(r"(\w+)\(([^()]*)\)", text):
        cols = []
        for part in body.split(", "):
            col, kind = part.split(" ", 1)
            kind, _, values = kind.partition("=")
            key = kind.endswith("*")  # a star stands before the values
            got = []
            if ".." in values:
                a, b = map(int, values.split(".."))
                got = list(range(a, b + 1))
            elif values:
                got = values.split("/")
            cols.append({"name": col, "type": kind.rstrip("*"), "is_primary_key": key, "sample_values": got})
        out.append({"table_name": name, "columns": cols})
    return out
