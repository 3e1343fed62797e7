"""Which column of a table plays which part.  Defaults fit the ``bookings`` view."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Layout:
    key: str = "booking_id"
    time: str = "booking_datetime"
    service: str = "service_type"
    services: tuple[str, ...] = ("1-URGENT", "2-HIGH")
    target: str = "basket_value"
    segment: str = "customer_segment"
    age: str = "customer_age"
    distance: str = "distance_km"
    duration: str = "estimated_duration_min"
    discount: str = "discount_amount"
    promo: str = "promo_code_used"
    traffic: str = "traffic_level"
    weather: str = "weather_condition"
    city: str = "city"
    payment: str = "payment_method"
    channel: str = "booking_channel"
    #: ranks the rows of one key; the first one is kept
    order_by: tuple[str, ...] = ("ord_a", "ord_b", "ord_c", "basket_value")
    clean_distance: str = "distance_km_clean"
    #: further numeric columns of the table, repaired like the others
    other_numeric: tuple[str, ...] = ()

    @property
    def numeric(self) -> tuple[str, ...]:
        return (
            self.age,
            self.distance,
            self.duration,
            self.target,
            self.discount,
            *self.other_numeric,
        )

    @property
    def categorical(self) -> tuple[str, ...]:
        return (
            self.segment,
            self.service,
            self.city,
            self.payment,
            self.channel,
            self.promo,
            self.traffic,
            self.weather,
        )

    @property
    def analysis(self) -> tuple[str, ...]:
        """The 13 variables whose missingness is assessed."""
        return (
            self.segment,
            self.service,
            self.age,
            self.city,
            self.payment,
            self.channel,
            self.distance,
            self.duration,
            self.promo,
            self.discount,
            self.traffic,
            self.weather,
            self.target,
        )

    @property
    def nested_predictors(self) -> tuple[tuple[str, ...], ...]:
        """Predictor groups in the order in which they enter the linear model."""
        return (
            (self.segment, self.service, self.age),
            (self.city, self.payment, self.channel, self.clean_distance, self.duration),
            ("time_period", "is_weekend"),
            (self.promo, self.discount),
            (self.traffic, self.weather),
        )

    @property
    def predictors(self) -> tuple[str, ...]:
        return (
            self.segment,
            self.service,
            self.age,
            self.city,
            self.payment,
            self.channel,
            self.clean_distance,
            self.duration,
            "time_period",
            "is_weekend",
            self.promo,
            self.discount,
            self.traffic,
            self.weather,
        )

    @property
    def raw_predictors(self) -> tuple[str, ...]:
        """Predictors before time features, with the distance as recorded."""
        return tuple(c for c in self.analysis if c != self.target)

    @property
    def model(self) -> tuple[str, ...]:
        return (self.key, *self.predictors, self.target)

    @property
    def impute_numeric(self) -> tuple[str, ...]:
        return (self.age, self.clean_distance)

    @property
    def impute_unknown(self) -> tuple[str, ...]:
        return (self.payment, self.traffic, self.weather, self.promo)

    @property
    def display_names(self) -> dict[str, str]:
        """Names of the variables in the missingness figure (fixed values)."""
        return {
            self.segment: "Customer\nsegment",
            self.service: "Service\ntype",
            self.age: "Customer\nage",
            self.city: "City",
            self.payment: "Payment\nmethod",
            self.channel: "Booking\nchannel",
            self.distance: "Distance",
            self.duration: "Estimated\nduration",
            self.promo: "Promo\ncode",
            self.discount: "Discount",
            self.traffic: "Traffic\nlevel",
            self.weather: "Weather\ncondition",
            self.target: "Basket\nvalue",
        }

    @property
    def imputed_names(self) -> dict[str, str]:
        """Names of the imputed numbers in the before / after comparison (fixed values)."""
        return {self.age: "Customer age", self.clean_distance: "Distance (km)"}
