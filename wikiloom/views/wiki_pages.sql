select cast(1000000+r_regionkey as string) page_id, 'GEO' space_key, r_name title, @ARR0@ ancestors from region
union all select cast(2000000+n_nationkey as string), 'GEO', n_name, @ARR(cast(1000000+n_regionkey as string))@ from nation
union all select cast(3000000+c_custkey as string), 'CRM', c_name, @ARR(cast(1000000+n_regionkey as string),cast(2000000+n_nationkey as string))@ from customer join nation on c_nationkey=n_nationkey
union all select cast(10000000+o_orderkey as string), 'ORD', 'Order '||o_orderkey, @ARR(cast(1000000+n_regionkey as string),cast(2000000+n_nationkey as string),cast(3000000+c_custkey as string))@ from orders join customer on o_custkey=c_custkey join nation on c_nationkey=n_nationkey
union all select cast(90000000+p_partkey as string), 'CAT', p_name, @ARR0@ from part
